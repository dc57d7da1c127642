"""Operators for preparing text corpora at scale (deduplication, mixing, classification, packing, extraction).

Nothing else in the library imports this subpackage.
"""
