"""Operators for training-data pipelines: encoding, filtering, deduplication and formatting of text corpora."""
