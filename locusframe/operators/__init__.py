"""Operators on intervals, tables, gene models and alignments."""
