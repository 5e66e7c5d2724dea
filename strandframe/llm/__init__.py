"""Operators for large text corpora and the queries that bind them to the tables."""
