"""Operators of a training-data pipeline: joins, models, filters, formats and shards of text."""
