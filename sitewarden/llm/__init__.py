"""Operators of a training-data pipeline: packing, scans, deduplication, search, classification, encoding, archives."""
