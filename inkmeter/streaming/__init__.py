"""Structured Streaming jobs over arriving documents and log rows."""
