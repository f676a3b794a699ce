"""Operators for training corpora: scans, deduplication, search, mixing, tokens and quality rules."""
