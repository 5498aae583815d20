"""Operators for preparing training data at scale.

Nothing else in the library imports this package. Every operator takes
DataFrames and column names, reads only the columns it needs under names of
its own (so extra or clashing input columns do no harm) and returns a
DataFrame; ``queries`` binds them to the given tables.
"""
