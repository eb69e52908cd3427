"""Operators for large text corpora, one module each."""
