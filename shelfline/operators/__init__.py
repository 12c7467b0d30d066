"""Relational operators of the archive catalog."""
