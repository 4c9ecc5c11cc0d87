"""Column functions: time, text and version helpers."""
