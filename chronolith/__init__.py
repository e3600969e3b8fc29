"""Time-series analytics as Spark jobs."""
