"""Relational and iterative operators on node, edge, chunk and vector tables."""
