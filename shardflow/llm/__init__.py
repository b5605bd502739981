"""Operators for building language-model training data.

Nothing outside this folder imports it.  Every operator takes and returns
DataFrames; ``queries`` holds the registered queries and their SQL.
"""
