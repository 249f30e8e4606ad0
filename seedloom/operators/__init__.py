"""Stages of the mapper, DataFrame in and DataFrame out."""
