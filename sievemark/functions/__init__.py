"""Scalar functions: canonical text, identities, globs and text helpers."""
