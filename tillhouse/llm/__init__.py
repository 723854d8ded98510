"""Operators of a training-data pipeline: dedup, mixing, sharding, scoring, tokenizing."""
