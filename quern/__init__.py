"""Telemetry sampling, reduction and enrichment on Spark DataFrames."""
