"""Strandwell: retrieval analytics over versioned code and document corpora, on Spark DataFrames."""
