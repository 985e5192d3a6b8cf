"""Operators for large text corpora: filters, near duplicates, mixing, tokens.

Nothing outside this subpackage imports it.
"""
