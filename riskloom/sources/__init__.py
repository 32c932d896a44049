"""Readers, writers, synthetic tables, and the mapping of the test tables."""
