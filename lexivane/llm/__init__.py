"""Operators of a training-data pipeline, each on Spark DataFrames.

Nothing else in the library imports this subpackage. Every operator module holds the operator with its
general interface; ``registry`` holds the registered queries and their SQL.
"""
