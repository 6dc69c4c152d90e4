"""Operators for training data made from the literature tables."""
