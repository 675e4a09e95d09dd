"""Registered queries, the inputs derived for them, and their SQL counterparts."""
