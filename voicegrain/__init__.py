"""Customer-feedback analytics on Spark: DataFrame, SQL and Structured Streaming throughout."""
