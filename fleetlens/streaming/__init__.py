"""Structured Streaming: the batch operators applied per micro-batch."""
