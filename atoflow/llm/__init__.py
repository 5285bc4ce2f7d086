"""Operators for preparing training text: packing, formatting, filtering, dedup, tokenization."""
