"""Micro-batch re-indexing and windowed event queries."""
