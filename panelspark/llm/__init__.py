"""Operators for preparing language-model training text on Spark.

Nothing else in the library imports this subpackage.  The registered queries
and their DuckDB counterparts are in :mod:`panelspark.llm.queries`.
"""
