"""Operators for training-data pipelines over very large text and number columns."""
