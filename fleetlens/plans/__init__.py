"""Composed data flows built from the operators."""
