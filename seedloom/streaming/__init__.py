"""Mapping of arriving reads."""
