"""Operators of a training-data pipeline: filtering, near-duplicates, personal data, mixing, tokens, files.

Nothing else in the library imports this package; only ``__spark_entry__`` does, and only where it exists.
"""
