"""Column functions on bases, seeds and mapping records."""
