"""Operators for preparing training data: near-duplicates, privacy, tokens, scores, shards and filters."""
