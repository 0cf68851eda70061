"""Incremental collection."""
