"""Readers, validation and tables."""
