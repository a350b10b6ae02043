"""Operators for preparing training text: deduplication, filters, redaction, tokens and shards."""
