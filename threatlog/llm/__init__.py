"""Operators for preparing training data: language, toxicity, duplicates, search, tokens, archives, personal data."""
