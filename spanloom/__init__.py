"""Agent-trace analytics expressed as Spark DataFrame and Structured Streaming transformations."""
