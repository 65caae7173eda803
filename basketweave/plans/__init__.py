"""Whole phases: which tables are written, in which order."""
