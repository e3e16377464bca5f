"""Operators on training text: dedup, mixing, classifiers, tokens, shards, similarity search."""
