"""SQLite-flavoured scalar and aggregate functions as Column builders; modules: datetime, json, strings, math, aggregates.

Spark's own functions are not overridden: these live in a Python namespace, and `register` makes them callable from SQL
under a prefix (x_ by default) where they take values of one type.
"""
