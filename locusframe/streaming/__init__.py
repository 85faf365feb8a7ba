"""Rows that keep coming."""
