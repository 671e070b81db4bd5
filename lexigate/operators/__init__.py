"""Relational operators over dictionaries, texts, requests and verdicts."""
