"""Operators of a training-data pipeline: counts, scans, deduplication, language, packing, files."""
