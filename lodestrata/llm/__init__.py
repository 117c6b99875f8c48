"""Operators for building language-model training data. Nothing outside imports this package."""
