"""Column-level helpers: hashing, type classes, statistics."""
