"""Part of paneloom: functions."""
