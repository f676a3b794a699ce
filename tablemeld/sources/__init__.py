"""Readers, writers and metadata documents."""
