"""Keyed index operators."""
