"""linkweave: link-shortening analytics as Spark DataFrame and Structured Streaming jobs."""
