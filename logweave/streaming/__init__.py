"""Structured Streaming forms of the chunkers."""
