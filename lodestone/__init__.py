"""Lodestone: evidence retrieval over text corpora, expressed as Spark DataFrames."""
