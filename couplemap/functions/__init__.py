"""functions of couplemap."""
