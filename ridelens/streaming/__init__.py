"""Structured Streaming entry points.

The analysis has no event-time logic, so nothing here keeps state: review
classification is a per-row projection and runs unchanged on a streaming
DataFrame. Offsets and sink commits live in the checkpoint folder the caller
names, so a query restarted with it resumes where it stopped.
"""

from ridelens.streaming.reviews import classify_review_files

__all__ = ["classify_review_files"]
