"""Operators for large training-data corpora: percentiles, distinct counts, tokens, mixtures, residue.

Nothing outside this package imports it.
"""
