"""Readers and work lists."""
