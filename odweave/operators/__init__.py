"""Operators on flows, points, networks, clusters and time series."""
