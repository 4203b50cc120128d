"""Operators for training-data corpora: dedup, quality, tokens, packing, classifiers."""
