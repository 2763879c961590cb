"""Operators for training-data pipelines over tables of texts; nothing else in the library imports them."""
