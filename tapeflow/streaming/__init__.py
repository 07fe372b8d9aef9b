"""Structured Streaming jobs over NDJSON trades and bars."""
