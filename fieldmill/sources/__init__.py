"""Readers; each yields the columns raw, source and meta."""
