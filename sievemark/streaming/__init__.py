"""Structured Streaming forms of the record store."""
