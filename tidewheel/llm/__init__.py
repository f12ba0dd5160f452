"""Operators for preparing training data: extraction, deduplication, packing, tokenising, scoring, search.

Nothing else in the library imports this subpackage.
"""
