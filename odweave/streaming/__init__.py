"""Structured Streaming variants of the time-series operators."""
