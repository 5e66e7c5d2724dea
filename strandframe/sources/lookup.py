"""Point lookups, parameter fall-backs and positional pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandframe.sources.records import splice


def entries_by_name(names: DataFrame, db: DataFrame) -> DataFrame:
    """Join requested ``(name, ranges)`` with database entries ``(name, s)`` and cut the ranges."""
    return names.join(db, "name").select("name", splice("s", "ranges").alias("part"))


def with_fallback(df: DataFrame, specific: DataFrame, general: DataFrame, key: str, wider: str, value: str) -> DataFrame:
    """Parameter of the specific key, or of the wider one when there is none."""
    a = specific.select(key, F.col(value).alias("_own"))
    b = general.select(wider, F.col(value).alias("_common"))
    return df.join(a, key, "left").join(b, wider, "left").withColumn(value, F.coalesce("_own", "_common")).drop("_own", "_common")


def row_index(df: DataFrame, key: str, width: int) -> DataFrame:
    """Rank from 1 by a numeric key: ranks inside key ranges plus the counts of the ranges before.

    Ranges are summed over ranges of ranges, so the only global order is over one row per ``width ** 2`` keys.
    """
    d = df.withColumn("_b", F.floor(F.col(key) / width))
    counts = d.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_c", F.floor(F.col("_b") / width))
    upper = counts.groupBy("_c").agg(F.sum("_n").alias("_m"))
    first = F.coalesce(F.sum("_m").over(W.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum("_n").over(W.partitionBy("_c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_in", inner).join(upper.select("_c", first.alias("_first")), "_c")
    d = d.join(counts.select("_b", (F.col("_first") + F.col("_in")).alias("_before")), "_b")
    return d.withColumn("idx", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy(key))).drop("_b", "_before")


def strand_from_phrases(c, phrases: list[tuple[int, str]]) -> Column:
    """1 forward, 2 reverse, 0 unknown: the first phrase of the table that occurs."""
    out = F
    for strand, phrase in phrases:
        out = out.when(F.contains(c, F.lit(phrase)), F.lit(strand))
    return out.otherwise(F.lit(0))
