"""Readers: exchange formats to record tables."""
