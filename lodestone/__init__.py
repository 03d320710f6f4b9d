"""Lodestone: keyed lookups over Parquet, on Spark."""
