"""Readers, sinks and stored tables."""
