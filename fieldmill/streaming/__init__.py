"""Stateful and continuous forms of the operators."""
