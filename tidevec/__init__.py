"""Filtered vector search and the operators around it, expressed with Spark DataFrames."""
