"""Operators of a training-data pipeline: search, filters, joins, mixing, archives, models and shards."""
