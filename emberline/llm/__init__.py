"""Operators for training data made for language models; nothing else in the package imports them."""
