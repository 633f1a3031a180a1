"""Scalar rules as Column expressions, and the fixed values they use."""
