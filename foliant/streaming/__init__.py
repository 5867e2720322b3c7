"""Structured Streaming versions of the import, index and category jobs."""
