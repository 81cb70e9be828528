"""Scalar and geometry functions as Column expressions, and the few vectorised Python ones."""
