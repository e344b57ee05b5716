"""Structured Streaming ingest of landed order files."""
