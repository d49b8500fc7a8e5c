"""Dataset curation and detection evaluation on Apache Spark."""
