"""Column expressions: hashing, vectors, mood maps and text."""
