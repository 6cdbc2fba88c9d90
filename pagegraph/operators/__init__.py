"""Ingest, graph lookups, traversal and statistics over DataFrames."""
