"""Queries of this subpackage by name: ``(run(spark, sf_dir), SQL or None)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CorpusQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(spark, sf_dir)


CORPUS: dict[str, CorpusQuery] = {}


def corpus_query(sql: str | None = None):
    def register(fn):
        CORPUS[fn.__name__] = CorpusQuery(fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
