"""Operators for preparing training text, each on its own; nothing else in the library imports them."""
