"""Operators for training-data pipelines: archives, deduplication, quality, secrets, tokens."""
