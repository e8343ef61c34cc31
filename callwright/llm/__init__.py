"""Operators of a training-data pipeline (tokens, packing, sharding, filters, dedup, search)."""
