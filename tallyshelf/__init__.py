"""Retail inventory analytics on Spark: load a star schema, then report on it lazily."""
