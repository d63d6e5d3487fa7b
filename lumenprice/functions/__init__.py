"""Scalar semantics as column expressions."""
