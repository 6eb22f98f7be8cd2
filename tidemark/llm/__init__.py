"""Operators for training-data pipelines: fingerprints, dedup, filters, mixing and packing of documents."""
