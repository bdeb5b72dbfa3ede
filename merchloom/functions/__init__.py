"""Scalar functions as Column expressions, and the HTML functions that Catalyst lacks."""
