"""Operators for preparing training text: dedup, filtering, mixing, search, sharding.

Nothing else in ``autokpi`` imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` registers one query each.
"""
