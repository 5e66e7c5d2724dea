"""Sequence comparison, clustering and annotation as Spark DataFrame jobs."""
