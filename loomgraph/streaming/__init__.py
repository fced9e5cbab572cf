"""Structured Streaming over payloads."""
