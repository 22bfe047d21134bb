"""Operators for large-scale training-data preparation. Nothing outside this folder imports it."""
