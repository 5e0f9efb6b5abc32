"""Part of paneloom: streaming."""
