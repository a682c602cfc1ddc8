"""Composed queries: search, impact, reports."""
