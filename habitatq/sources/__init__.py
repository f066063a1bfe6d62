"""Readers and writers for survey tables."""
