"""Operators for training-data pipelines: filters, joins, formatting, packing and token files."""
