"""Registered queries with their SQL counterparts, over the given tables."""
