"""Operators of a training-data pipeline: dedup, filtering, tagging and mixing of text."""
