"""Training-data operators: scoring, deduplication, formatting, packing, scanning, encoding, search.

Nothing outside this subpackage imports it.
"""
