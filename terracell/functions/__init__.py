"""Column expressions: no shuffle, no Python workers unless stated."""
