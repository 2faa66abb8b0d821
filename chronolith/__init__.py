"""Time-aware knowledge graphs and text retrieval as Spark plans."""
