"""Batch operators on ledger tables."""
