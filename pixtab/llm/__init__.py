"""Operators for preparing training data: search, filtering, tokenising, deduplication, packing."""
