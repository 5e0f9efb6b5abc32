"""Part of paneloom: sources."""
