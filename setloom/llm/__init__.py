"""Operators for preparing training data: deduplication, archives, classifiers, mixing, packing, search, extraction."""
