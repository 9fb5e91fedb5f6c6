"""Composed queries and the tool-level requests."""
