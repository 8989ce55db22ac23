"""Training-data operators: one module for each, all built on Spark DataFrames.

Nothing else in the library imports this subpackage.
"""
