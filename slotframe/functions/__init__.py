"""Column functions: names, bytes, base58, times."""
