"""Operators for training-data corpora: tokens, classifiers, scans, similarity joins, search, packing."""
