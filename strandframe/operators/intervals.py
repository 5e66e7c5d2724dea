"""Interval sets per key: union, intersection, complement and coverage.

All running values are two-level prefix scans: rows are cut into position
buckets, a small per-bucket table carries the value over bucket borders and a
window runs inside each ``(key, bucket)``.  A key that holds a third of all
rows is therefore spread over as many tasks as it has buckets, and rows are
reduced to one per position before they are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def running(df: DataFrame, keys: list[str], bucket: str, order: list, value, how, name: str, inclusive: bool) -> DataFrame:
    """Add ``name``: ``how`` (F.sum or F.max) of ``value`` over all earlier rows of the key."""
    totals = df.groupBy(*keys, bucket).agg(how(value).alias("_t"))
    over_buckets = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, bucket, how("_t").over(over_buckets).alias("_carry"))
    inside = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = df.join(carry, [*keys, bucket]).withColumn("_in", how(value).over(inside))
    if how is F.max:
        combined = F.greatest("_carry", "_in")
    else:
        combined = F.coalesce("_carry", F.lit(0)) + F.coalesce("_in", F.lit(0))
    return out.withColumn(name, combined).drop("_carry", "_in")


def following(df: DataFrame, keys: list[str], bucket: str, position: str, name: str) -> DataFrame:
    """Add ``name``: the next larger position of the key, across bucket borders; null at the end."""
    firsts = df.groupBy(*keys, bucket).agg(F.min(position).alias("_f"))
    carry = firsts.select(*keys, bucket, F.lead("_f").over(W.partitionBy(*keys).orderBy(bucket)).alias("_next"))
    inside = W.partitionBy(*keys, bucket).orderBy(position)
    return df.join(carry, [*keys, bucket]).withColumn(name, F.coalesce(F.lead(position).over(inside), "_next")).drop("_next")


def _islands(df: DataFrame, keys: list[str], width: int, near: int) -> DataFrame:
    """``(*keys, l, r, island)`` by left end: the furthest right end of it, and the number of its union.

    Rows are reduced to one per left end before anything is ordered, so a key has
    no more rows here than positions, whatever the number of its intervals.
    """
    d = df.groupBy(*keys, "l").agg(F.max("r").alias("r")).withColumn("_b", F.floor(F.col("l") / width))
    d = running(d, keys, "_b", ["l"], F.col("r"), F.max, "_reach", False)
    d = d.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col("l") > F.col("_reach") + near), 1).otherwise(0))
    return running(d, keys, "_b", ["l"], F.col("_new"), F.sum, "island", True).select(*keys, "l", "r", "island")


def with_islands(df: DataFrame, keys: list[str], width: int, near: int = 0) -> DataFrame:
    """Number the unions of intervals ``[l, r)`` that touch, overlap or lie within ``near``."""
    return df.join(_islands(df, keys, width, near).drop("r"), [*keys, "l"]).select(*df.columns, "island")


def union(df: DataFrame, keys: list[str], width: int, near: int = 0) -> DataFrame:
    d = _islands(df, keys, width, near)
    return d.groupBy(*keys, "island").agg(F.min("l").alias("l"), F.max("r").alias("r")).drop("island")


def _points(df: DataFrame, keys: list[str], *depths: tuple[str, int]) -> DataFrame:
    """Boundary rows: +weight at the left end and -weight at the right end per depth column."""
    def edge(at: str, sign: int):
        return F.struct(F.col(at).alias("p"), *[F.lit(sign * w).alias(name) for name, w in depths])

    return df.select(*keys, F.explode(F.array(edge("l", 1), edge("r", -1))).alias("x")).select(*keys, "x.*")


def _segments(points: DataFrame, keys: list[str], width: int, depths: list[str]) -> DataFrame:
    """Elementary segments between boundaries with running depths: one two-level scan for all of them."""
    d = points.groupBy(*keys, "p").agg(*[F.sum(x).alias(x) for x in depths]).withColumn("_b", F.floor(F.col("p") / width))
    totals = d.groupBy(*keys, "_b").agg(F.min("p").alias("_first"), *[F.sum(x).alias(f"_t_{x}") for x in depths])
    over = W.partitionBy(*keys).orderBy("_b")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_b", F.lead("_first").over(over).alias("_next"), *[F.coalesce(F.sum(f"_t_{x}").over(before), F.lit(0)).alias(f"_c_{x}") for x in depths]
    )
    inside = W.partitionBy(*keys, "_b").orderBy("p")
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    d = d.join(carry, [*keys, "_b"])
    return d.select(
        *keys, "p", F.coalesce(F.lead("p").over(inside), "_next").alias("q"),
        *[(F.col(f"_c_{x}") + F.sum(x).over(upto)).alias(f"depth_{x}") for x in depths],
    ).filter("q IS NOT NULL")


def intersection(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Common parts of two interval sets by one sweep over both: linear in the input, no pairs."""
    points = _points(a, keys, ("a", 1), ("b", 0)).unionByName(_points(b, keys, ("a", 0), ("b", 1)))
    seg = _segments(points, keys, width, ["a", "b"]).filter("depth_a > 0 AND depth_b > 0")
    return union(seg.select(*keys, F.col("p").alias("l"), F.col("q").alias("r")), keys, width)


def complement(df: DataFrame, keys: list[str], width: int, left: int, right: int) -> DataFrame:
    """Parts of ``[left, right)`` outside the intervals, for every key that has any interval."""
    u = union(df, keys, width)
    ends = u.groupBy(*keys).agg(F.min("l").alias("lo"), F.max("r").alias("hi"))
    edge = ends.select(*keys, F.lit(left).alias("l"), F.col("lo").alias("r")).unionByName(
        ends.select(*keys, F.col("hi").alias("l"), F.lit(right).alias("r"))
    )
    d = following(u.withColumn("_b", F.floor(F.col("l") / width)), keys, "_b", "l", "nl").filter("nl IS NOT NULL")
    inner = d.select(*keys, F.col("r").alias("l"), F.col("nl").alias("r"))
    t = dict(u.dtypes)["l"]
    return inner.unionByName(edge.select(*keys, F.col("l").cast(t), F.col("r").cast(t))).filter("l < r")


def coverage(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Maximal segments of constant depth > 0."""
    seg = _segments(_points(df, keys, ("d", 1)), keys, width, ["d"])
    return seg.filter("depth_d > 0").select(*keys, F.col("p").alias("l"), F.col("q").alias("r"), F.col("depth_d").alias("depth"))


def best_per_cluster(df: DataFrame, keys: list[str], width: int, score: str, ident: str) -> DataFrame:
    """One representative per overlap cluster: highest score, then smallest id."""
    d = with_islands(df, keys, width)
    best = F.max_by(F.struct(ident, score), F.struct(F.col(score), -F.col(ident)))
    return d.groupBy(*keys, "island").agg(best.alias("z"), F.count("*").alias("members")).select(*keys, "z.*", "members")
