"""Structured Streaming jobs over posts."""
