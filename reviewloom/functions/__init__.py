"""Column and Arrow-batch functions."""
