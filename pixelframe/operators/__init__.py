"""Relational operators over image and report tables."""
