"""Readers and writers of graph and tree files."""
