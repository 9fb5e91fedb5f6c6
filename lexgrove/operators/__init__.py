"""Operators over document trees, law lists and revision histories."""
