"""Columns and parsers that operators are made of."""
