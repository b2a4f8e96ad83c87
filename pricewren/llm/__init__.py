"""Operators for preparing language-model training data. Nothing else in pricewren imports this package."""
