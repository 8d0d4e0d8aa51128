"""Queries over the test tables."""
