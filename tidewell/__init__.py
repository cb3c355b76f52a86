"""Guarded, schema-aware analytics on PySpark DataFrames."""
