"""Web-asset audit as Spark DataFrame and Structured Streaming jobs."""
