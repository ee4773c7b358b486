"""Structured Streaming operators and bounded runs of them."""
