"""Curation of source-code and document corpora as Spark DataFrames."""
