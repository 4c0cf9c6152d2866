"""Scalar functions on columns: paths and globs, text, vectors."""
