"""Operators for preparing model training data; nothing else in the package imports them."""
