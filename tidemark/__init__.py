"""Spark-first semantic statistics engine: text, token, vector, event and audit operators on DataFrames."""
