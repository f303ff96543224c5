"""Operators for training-data pipelines: deduplication, filtering, extraction, decontamination and mixing."""
