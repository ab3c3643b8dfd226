"""Operators on text, vectors and groups of copies for training data. Nothing outside this folder imports it."""
