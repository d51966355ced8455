"""Operators for preparing language-model training data; nothing else in tessera imports this."""
