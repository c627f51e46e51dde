"""Readers, writers, column roles and the shared scratch tables."""
