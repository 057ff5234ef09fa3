"""Scans and sinks: strict JSON Lines, keyed artifacts with journals, corpus loaders, reports."""
