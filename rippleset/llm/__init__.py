"""Operators of a training-data pipeline: deduplication, filters, tokenizers, search and scans over document tables."""
