"""Readers, writers and the persisted index."""
