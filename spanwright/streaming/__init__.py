"""Structured Streaming extensions: incremental ingest and audit windows."""
