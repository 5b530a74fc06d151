"""Scalar expressions: geometry and projections, text, dates, codes, vectors, hashes."""
