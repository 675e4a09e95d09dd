"""DataFrame operators of the corpus engine."""
