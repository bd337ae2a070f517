"""Operators that prepare large text collections for training.

Nothing outside this package imports it; the queries are in ``queries.py``.
"""
