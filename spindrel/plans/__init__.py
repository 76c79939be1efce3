"""Helpers that shape physical plans: lineage cuts, salting, routing."""
