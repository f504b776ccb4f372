"""Operators for training-data pipelines over large text corpora."""
