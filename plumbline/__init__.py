"""Schema contracts, lineage and training-data operators on PySpark."""
