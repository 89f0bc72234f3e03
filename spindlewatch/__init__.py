"""Block-device I/O analytics expressed as Spark DataFrame operations."""
