"""Structured Streaming jobs that keep record tables current."""
