"""Operators for training-data pipelines: sharding, licence scans, extraction, deduplication, filtering, formatting, encoding."""
