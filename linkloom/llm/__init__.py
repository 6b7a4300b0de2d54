"""Operators for building language-model training corpora.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns a DataFrame; ``queries`` registers one query for each.
"""
