"""Readers, writers and the graph views over the star-schema tables."""
