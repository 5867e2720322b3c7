"""Operators for preparing training data: filters, deduplication, mixing, token counts and packing."""
