"""Operators for preparing training text: dedup, scoring, mixing, sharding, formatting, search and output.

Nothing else in the library imports this subpackage.
"""
