"""Training-data operators: dedup, packing, tokenizing, scoring, filtering.

Nothing else in the library imports this subpackage.
"""
