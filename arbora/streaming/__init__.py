"""Queries as a stream."""
