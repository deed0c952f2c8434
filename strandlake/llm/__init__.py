"""Operators for training data from text. Nothing outside this subpackage imports it."""
