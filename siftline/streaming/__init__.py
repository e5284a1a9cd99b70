"""Structured Streaming forms of the ordered folds and of deduplication."""
