"""Relational operators on the link-health tables."""
