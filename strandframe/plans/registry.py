"""Query registry used by the driver entry, the tests and the benchmark."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from strandframe.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}

MODULES = ["residue_queries", "alignment_queries", "interval_queries", "gene_queries", "search_queries", "alignment_kernel_queries", "io_queries", "reader_queries", "profile_queries", "tree_queries", "region_queries", "signal_queries", "matrix_queries"]


def query(ops: str, sql: str | None = None):
    """Register a query under its function name; ``ops`` lists the inventory ids it covers."""

    def register(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        QUERIES[fn.__name__] = Query(fn.__name__, ops, fn, sql)
        return fn

    return register


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"strandframe.plans.{name}")
