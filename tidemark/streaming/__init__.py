"""Structured Streaming jobs over landed article files."""
