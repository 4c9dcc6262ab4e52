"""Lectern: document-library analytics and retrieval on Spark DataFrames."""
