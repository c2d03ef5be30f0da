"""Relational operators over repository tables."""
