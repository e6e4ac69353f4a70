"""Readers of landed files and paged sources."""
