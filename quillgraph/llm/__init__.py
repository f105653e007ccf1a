"""Operators of a training-data pipeline: rules, deduplication, cleaning, mixing and sharding.

Nothing outside this folder imports it; it may be removed as a whole.
"""
