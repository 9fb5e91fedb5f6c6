"""Spark jobs over hierarchical, versioned document corpora."""

__version__ = "0.1.0"
