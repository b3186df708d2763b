"""Operators of a training-data pipeline: cleaning, duplicates, leaks, scores, tokens."""
