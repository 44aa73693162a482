"""Scalar functions: Column expressions, and driver-side special functions and distributions."""
