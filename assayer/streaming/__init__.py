"""Streaming forms of windowed counts."""
