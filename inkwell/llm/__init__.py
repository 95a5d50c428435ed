"""Operators of a training-data pipeline: one module per operator, each with a general function
on DataFrames and a thin registered query (``queries.py``). Nothing else in the library imports
this subpackage."""
