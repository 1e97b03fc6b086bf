"""Operators that prepare training text: extraction, filters, deduplication, packing, encoding."""
