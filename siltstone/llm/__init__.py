"""Operators of a training-data pipeline: dedup, sharding, packing, scoring."""
