"""Operators that prepare text and records for training data."""
