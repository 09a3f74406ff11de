"""Spark jobs for acoustic-event data."""
