"""Part of paneloom: plans."""
