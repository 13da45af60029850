"""Operators for large text corpora: deduplication, archives, cleaning, scoring and mixing.

Nothing outside this folder imports it; ``queries`` registers what it offers.
"""
