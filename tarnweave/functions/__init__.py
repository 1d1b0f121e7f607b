"""Column builders and row-level functions."""
