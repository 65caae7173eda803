"""Readers and writers of the tables between stages."""
