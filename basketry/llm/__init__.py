"""Operators for large-scale training-data preparation over ``documents``.

One module per operator, each a DataFrame -> DataFrame function with its own
general interface; ``queries`` holds the registered ``opN_<name>`` queries that
apply them to the whole table and their SQL. Nothing else in the library
imports this package.
"""
