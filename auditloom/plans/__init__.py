"""Whole audits: which operators run, on what, in which order."""
