"""Incremental upkeep of a table of documents."""
