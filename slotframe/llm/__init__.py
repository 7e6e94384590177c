"""Operators for large text corpora: search, archives, near-duplicates, shards, filters, classifiers."""
