"""Argument checks and scalar helpers."""
