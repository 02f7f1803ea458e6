"""Lexispark: search, maintenance and preparation of text corpora on Spark DataFrames."""
