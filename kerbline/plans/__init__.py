"""Registered queries: each reads the given tables and returns a DataFrame."""
