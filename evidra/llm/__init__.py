"""Operators for training-text preparation. Nothing outside this package imports it."""
