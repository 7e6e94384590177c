"""Structured Streaming operators on ledger streams."""
