"""Operators for training data: deduplication, tokenisation, filtering, mixing, search, packing."""
