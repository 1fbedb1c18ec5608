"""Structured Streaming forms of the loaders and of snapshot sync."""
