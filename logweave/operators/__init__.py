"""Relational operators over the message log."""
