"""Structured Streaming over review events."""
