"""Operators for training data at scale: sketches, selection, tokenizing, mixing and splitting.

Nothing else in the package imports this subpackage.
"""
