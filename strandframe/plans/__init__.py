"""Registered queries: each binds operators to the given tables, with SQL where SQL can say it."""

from strandframe.plans.registry import QUERIES, load_all

load_all()
