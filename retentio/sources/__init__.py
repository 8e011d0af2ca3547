"""Readers, writers and the adapter views over the shared test tables."""
