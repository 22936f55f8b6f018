"""Sextant: retrieval over privacy-gated notes, its evaluation and its work queue, on Spark DataFrames."""
