"""Sinks: labelled tables, summaries, reports and fitted models."""
