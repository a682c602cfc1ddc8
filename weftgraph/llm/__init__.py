"""Operators for training data on language models; nothing else in the package imports them."""
