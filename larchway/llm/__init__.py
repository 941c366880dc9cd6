"""Operators for training-data pipelines: packing, token counts, deduplication, scoring and filtering."""
