"""Column functions: hashing, names, display text, YAML/JSON helpers."""
