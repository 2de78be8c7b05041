"""Scalar, aggregate and table functions as Column expressions."""
