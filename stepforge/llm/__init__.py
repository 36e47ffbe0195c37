"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. ``queries.QUERIES`` and
``queries.ORACLE_SQL`` hold what the driver entry registers.
"""
