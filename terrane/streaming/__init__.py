"""Structured Streaming forms of the read ingest."""
