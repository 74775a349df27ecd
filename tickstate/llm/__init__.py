"""Operators for preparing training data: text, vectors, urls and token files."""
