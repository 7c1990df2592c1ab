"""Operators over node, edge and query tables."""
