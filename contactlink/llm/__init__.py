"""Operators for preparing training data: deduplication, counting, scoring, mixing, formatting, packing."""
