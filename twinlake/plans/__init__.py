"""Declarative pipelines built from the operators."""
