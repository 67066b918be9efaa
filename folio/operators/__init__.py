"""Relational operators over documents, chunks and queries."""
