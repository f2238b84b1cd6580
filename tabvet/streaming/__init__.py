"""Structured Streaming monitors (M-series)."""
