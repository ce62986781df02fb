"""Scalar functions, as column expressions that stay in the JVM."""
