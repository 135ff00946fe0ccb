"""Readers and writers of domain files."""
