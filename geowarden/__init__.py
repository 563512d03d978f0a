"""A rules engine for device telemetry on Spark DataFrames."""
