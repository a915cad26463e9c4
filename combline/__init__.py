"""Colony-telemetry analytics and data preparation on Spark DataFrames."""
