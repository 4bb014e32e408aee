"""Queries over the test tables: note corpora, indexes and task lists derived from them."""
