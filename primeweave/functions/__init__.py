"""Column functions: exact arithmetic, number theory, bit lengths."""
