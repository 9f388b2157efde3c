"""couplemap: change-coupling maps on Spark (see README.md)."""
