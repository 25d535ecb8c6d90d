"""Operators for training-data corpora: deduplication, scoring, tokens, filters, shards."""
