"""Streams into an index."""
