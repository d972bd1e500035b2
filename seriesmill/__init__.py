"""Contest analytics for Spark: games -> series -> leak-free features -> models."""
