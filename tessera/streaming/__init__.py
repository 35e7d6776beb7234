"""Continuous operators on Structured Streaming."""
