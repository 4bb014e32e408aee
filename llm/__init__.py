"""Operators for large text corpora: cleaning, deduplication, classification, tokens."""
