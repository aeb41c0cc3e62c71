"""Readers, writers and shared intermediate tables."""
