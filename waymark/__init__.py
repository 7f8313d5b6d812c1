"""Waymark: retrieval-strategy analytics as Spark plans."""
