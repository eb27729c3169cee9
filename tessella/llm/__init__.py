"""Operators for preparing training text: search, privacy, tokenizing, mixing, dedup, archives, classifiers."""
