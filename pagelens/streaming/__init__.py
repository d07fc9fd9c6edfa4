"""Structured Streaming versions of the ledger and page rules."""
