"""Operators of a training-data pipeline on Spark: packing, quality, search, mixing, dedup, scans, token files.

Nothing outside this folder imports it; ``queries.py`` lists its registered queries.
"""
