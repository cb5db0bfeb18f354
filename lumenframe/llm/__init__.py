"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage. Every operator works on
plain DataFrames; ``queries`` holds the thin driver queries.
"""
