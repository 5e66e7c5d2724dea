"""Continuous input: sequence files that arrive in a folder."""
