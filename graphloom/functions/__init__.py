"""Scalar statistics and seeded randomness as DataFrame expressions."""
