"""Operators for preparing training data: scans, packing, sharding, archives, tokens, rules, near duplicates, privacy."""
