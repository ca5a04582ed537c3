"""Flight-operations analytics as Spark jobs."""
