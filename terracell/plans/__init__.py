"""Join strategies, scratch space and the operation graph."""
