"""Queries with their DuckDB equivalents."""
