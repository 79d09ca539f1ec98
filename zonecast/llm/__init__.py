"""Operators for preparing training data: text, near copies, archives, tokens."""
