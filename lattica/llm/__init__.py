"""Training-data operators: deduplication, tokenization, filtering, mixing, sharding.

Nothing outside this package imports it.  Each operator module holds a general
DataFrame operator; ``queries`` holds the thin contract queries on top of them.
"""
