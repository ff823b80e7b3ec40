"""Readers, writers and the adapters from the sample tables."""
