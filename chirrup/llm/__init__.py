"""Operators for preparing training text: tokens, duplicates, archives, filters and mixtures."""
