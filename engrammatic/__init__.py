"""Conversational-memory analytics on Spark: operators from DataFrames to DataFrames."""
