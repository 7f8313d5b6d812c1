"""Lanes on disk: snapshots, adapters, caches, uploads."""
