"""Package of Spark jobs."""
