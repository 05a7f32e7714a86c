"""Operators of a training-data pipeline: filters, duplicates, tokens, shards."""
