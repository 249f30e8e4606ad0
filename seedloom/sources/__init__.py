"""Readers of sequences, writers of mappings."""
