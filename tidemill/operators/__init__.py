"""Operators over DataFrames of pages, URLs and snapshots."""
