"""Structured Streaming on top of the library: ingest of Markdown files as they arrive, and sessions of events."""
