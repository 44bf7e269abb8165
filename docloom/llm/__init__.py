"""Operators for building training data from a document corpus.

Nothing outside this package imports it; `queries()` and `oracle_sql()` are
collected by the driver's entry module only if the package can be imported.
"""
