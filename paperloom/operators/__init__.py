"""Relational operators over boxes, lines, tables, chapters and metrics."""
