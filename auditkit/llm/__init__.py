"""Operators for preparing training data: deduplication, search, token files, chat texts, filters and packing."""
