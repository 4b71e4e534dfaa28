"""Operators of a training-data pipeline: deduplication, filtering, packing."""
