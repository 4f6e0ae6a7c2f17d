"""Operators that prepare training text: filters, deduplication, scoring, packing."""
