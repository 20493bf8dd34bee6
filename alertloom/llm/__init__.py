"""Operators for preparing training text: scoring, de-duplication, mixing, packing, search and extraction."""
