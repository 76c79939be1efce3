"""Operators of the retrieval engine. They take and return DataFrames."""
