"""Incremental ingest of run logs with Structured Streaming."""
