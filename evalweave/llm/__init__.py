"""Operators for preparing training text: sharding, token files, dedup, rules, mixing, packing, search."""
