"""Scalar functions: distances, literals, checksums."""
