"""Operators of a training-data pipeline: quality, mixing, duplicates, personal data, tokens."""
