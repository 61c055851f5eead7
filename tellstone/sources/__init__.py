"""Readers of tables, files and feeds."""
