"""Operators for large collections of training records."""
