"""Operators of a training-data pipeline: dedup, tokenising, sharding, search, PII, packing."""
