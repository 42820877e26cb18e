"""Incremental capture and ingest with Structured Streaming."""
