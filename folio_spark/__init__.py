"""Page-sequence and document-assembly operators for PySpark."""
