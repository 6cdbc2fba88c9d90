"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Every module holds one
operator with a general interface, the thin registered query ``opN_<name>`` and,
where SQL can express the result, its DuckDB oracle.
"""
