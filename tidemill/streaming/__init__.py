"""Structured Streaming: watching pages for change."""
