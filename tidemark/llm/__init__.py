"""Training-data operators: deduplication, scanning, tokenizing, scoring, packing.

Nothing outside this subpackage imports it.
"""
