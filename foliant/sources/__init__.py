"""Readers and writers of the library tables."""
