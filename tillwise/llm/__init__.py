"""Operators for preparing text corpora: deduplication, language, personal data, mixing, formatting."""
