"""paneloom: documents and records to analysis-ready panels and estimates, as Spark plans."""
