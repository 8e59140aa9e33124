"""Operators of a training-data pipeline: duplicates, quality, search, packing, tokens, shards."""
