"""Operators for training-data pipelines: deduplication, token counts, scoring, packing."""
