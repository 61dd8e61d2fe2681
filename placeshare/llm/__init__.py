"""Operators for preparing training data, one module each; nothing else here imports them."""
