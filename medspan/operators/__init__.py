"""Relational operators: mentions, retrieval, graph closure, scoring and projection, display."""
