"""Operators of a training-data pipeline: text quality, deduplication, screening, tokenisation and sharding.

Nothing outside this subpackage imports it.
"""
