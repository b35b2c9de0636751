"""Column builders: text, levels, urls."""
