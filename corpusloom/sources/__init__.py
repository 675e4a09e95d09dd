"""Captured inputs and the corpus table."""
