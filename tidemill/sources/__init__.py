"""Scans of stored pages, URL lists, documents and search replies, and output formats."""
