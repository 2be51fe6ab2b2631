"""Text-embedding analytics on Spark: texts to vectors as DataFrame operations."""
