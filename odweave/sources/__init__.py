"""Readers, writers, catalog operators and deterministic fixtures."""
