"""Operators that prepare texts and records for training; nothing outside imports them."""
