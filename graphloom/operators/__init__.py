"""Relational operators: dedup, resolution, relations, graph."""
