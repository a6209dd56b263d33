"""Readers, writers and staging tables."""
