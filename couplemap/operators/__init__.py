"""operators of couplemap."""
