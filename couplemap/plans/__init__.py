"""plans of couplemap."""
