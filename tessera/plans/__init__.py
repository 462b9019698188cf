"""Composite jobs built from operators (clean, train, search, report)."""
