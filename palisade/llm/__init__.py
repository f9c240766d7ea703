"""Operators for preparing language-model training data. Nothing else in palisade imports this."""
