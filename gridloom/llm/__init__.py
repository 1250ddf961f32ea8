"""Operators for preparing language-model training data on Spark.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` holds the thin registered
queries over the given tables and their SQL.
"""
