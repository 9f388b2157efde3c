"""sources of couplemap."""
