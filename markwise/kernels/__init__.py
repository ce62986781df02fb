"""Array kernels for what has no relational form: NumPy only, no Spark."""
