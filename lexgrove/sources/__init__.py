"""Readers and built-in dimension tables."""
