"""Streams: change chains with state for each page, and alerts that are told once."""
