"""Operators: profiling, cleaning, features, encoding, clustering, metrics."""
