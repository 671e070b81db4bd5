"""Structured Streaming forms of the operators (requests, chunks, verdicts)."""
