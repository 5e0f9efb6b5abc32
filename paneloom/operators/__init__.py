"""Part of paneloom: operators."""
