"""emberline: an evidence-backed memory-graph engine written as PySpark plans."""
