"""Tidewater: object-store analytics on PySpark (DataFrames, SQL, Structured Streaming)."""
