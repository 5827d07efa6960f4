"""Readers, topic sources and test-table adapters."""
