"""Training-data operators: packing, deduplication, search, sanitising, tokens, quality.

Nothing outside this folder imports it.
"""
