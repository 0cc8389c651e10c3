"""Operators for training data: text, names and entity matching. Nothing outside imports this package."""
