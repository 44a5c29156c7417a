"""Text-event feed analytics as Spark DataFrame, SQL and streaming jobs."""
