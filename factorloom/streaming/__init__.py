"""Structured Streaming forms of the daily risk measures."""
