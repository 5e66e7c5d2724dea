"""Coordinates through gaps: piecewise shifts as sorted tables.

A map ``(*keys, x_l, x_r, y_l)`` takes x in ``[x_l, x_r]`` to ``y_l + x - x_l``; the
pieces of a key rise in x and y.  An alignment row is the map from its residues to
its sites; its gaps are the holes on the y side.  Maps are inverted by swapping the
sides and composed by an overlap join; intervals find their pieces by an equi-join
on buckets of ``WIDTH`` positions, so neither a row nor a key is gathered.

Windows run over the pieces of one row, which its length bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

WIDTH = 256


def from_gaps(gaps: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The map that inserts ``gaps (*keys, gps, gln)`` after ``gps`` sites of the gapped row; ``spans (*keys, width)`` has its whole width."""
    start = spans.select(*keys, F.lit(0).cast("long").alias("gps"), F.lit(0).cast("long").alias("gln"))
    g = gaps.select(*keys, F.col("gps").cast("long").alias("gps"), F.col("gln").cast("long").alias("gln")).unionByName(start)
    g = g.groupBy(*keys, "gps").agg(F.max("gln").alias("gln")).join(spans, keys)
    w = W.partitionBy(*keys).orderBy("gps")
    last, shift = F.col("gps") + F.col("gln"), F.sum("gln").over(w)
    d = g.select(*keys, (last + 1).alias("y_l"), F.coalesce(F.lead("gps").over(w), F.col("width").cast("long")).alias("y_r"), shift.alias("shift")).filter("y_l <= y_r")
    return d.select(*keys, (F.col("y_l") - F.col("shift")).alias("x_l"), (F.col("y_r") - F.col("shift")).alias("x_r"), "y_l")


def gaps_of(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps inside and before the pieces of a map: ``(*keys, gps, gln)``."""
    w = W.partitionBy(*keys).orderBy("x_l")
    end = F.col("y_l") + F.col("x_r") - F.col("x_l")
    d = pieces.withColumn("gps", F.coalesce(F.lag(end).over(w), F.lit(0)).cast("long")).withColumn("gln", F.col("y_l") - F.col("gps") - 1)
    return d.filter("gln > 0").select(*keys, "gps", "gln")


def inverse(pieces: DataFrame, keys: list[str]) -> DataFrame:
    return pieces.select(*keys, F.col("y_l").alias("x_l"), (F.col("y_l") + F.col("x_r") - F.col("x_l")).alias("x_r"), F.col("x_l").alias("y_l"))


def normal(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring pieces of one shift joined."""
    w = W.partitionBy(*keys).orderBy("x_l")
    shift = F.col("y_l") - F.col("x_l")
    new = F.when((F.lag("x_r").over(w) + 1 == F.col("x_l")) & (F.lag(shift).over(w) == shift), 0).otherwise(1)
    d = pieces.withColumn("new", new).withColumn("k", F.sum("new").over(w))
    return d.groupBy(*keys, "k").agg(F.min("x_l").alias("x_l"), F.max("x_r").alias("x_r"), F.min("y_l").alias("y_l")).drop("k")


def _spread(d: DataFrame, low, high, name: str = "b") -> DataFrame:
    return d.withColumn(name, F.explode(F.sequence(F.floor(low / WIDTH), F.floor(high / WIDTH))))


def compose(first: DataFrame, then: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """``then`` after ``first``; ``then`` is keyed by ``shared`` columns, a part of ``keys``."""
    f = first.withColumn("y_r", F.col("y_l") + F.col("x_r") - F.col("x_l"))
    f = _spread(f, F.col("y_l"), F.col("y_r"))
    g = then.select(*shared, F.col("x_l").alias("u_l"), F.col("x_r").alias("u_r"), F.col("y_l").alias("z_l"))
    met = f.join(_spread(g, F.col("u_l"), F.col("u_r")), [*shared, "b"])
    low, high = F.greatest("y_l", "u_l"), F.least("y_r", "u_r")
    met = met.filter(low <= high).filter(F.col("b") == F.floor(low / WIDTH))  # each overlap once
    d = met.select(*keys, (F.col("x_l") + low - F.col("y_l")).alias("x_l"), (F.col("x_l") + high - F.col("y_l")).alias("x_r"), (F.col("z_l") + low - F.col("u_l")).alias("y_l"))
    return normal(d, keys)


def image(intervals: DataFrame, pieces: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """Intervals ``(*keys, *ident, l, r)`` carried over; an end in a hole moves inwards, and what lies in a hole as a whole is left out."""
    w = W.partitionBy(*keys).orderBy("x_l")
    end = F.col("y_l") + F.col("x_r") - F.col("x_l")
    p = pieces.select(*keys, "x_l", "x_r", "y_l", F.lag("x_r").over(w).alias("before"), F.lag(end).over(w).alias("y_before"), F.lead("x_l").over(w).alias("after"), end.alias("y_r"))
    exact = F.struct(F.col("x_l").alias("p"), F.col("x_r").alias("q"), F.col("y_l").alias("low"), F.lit(None).cast("long").alias("high"))
    # the hole before a piece: a left end goes to the piece, a right end to the one before
    hole = F.struct((F.coalesce("before", F.lit(-1)) + 1).alias("p"), (F.col("x_l") - 1).alias("q"), F.col("y_l").alias("low"), F.coalesce("y_before", F.lit(0)).alias("high"))
    rest = F.struct((F.col("x_r") + 1).alias("p"), F.lit(2**62).alias("q"), F.lit(None).cast("long").alias("low"), F.col("y_r").alias("high"))
    cover = p.select(*keys, F.explode(F.array(exact, hole)).alias("c")).select(*keys, "c.*").filter("p <= q")
    tail = p.filter("after IS NULL").select(*keys, rest.alias("c")).select(*keys, "c.*")
    cover = _spread(cover, F.col("p"), F.col("q"))

    def place(d: DataFrame, c: str) -> DataFrame:
        at = d.withColumn("b", F.floor(F.col(c) / WIDTH))
        low = F.when(F.col("high").isNull(), F.col("low") + F.col(c) - F.col("p")).otherwise(F.col("low"))
        high = F.when(F.col("high").isNull(), F.col("low") + F.col(c) - F.col("p")).otherwise(F.col("high"))
        inside = (F.col(c) >= F.col("p")) & (F.col(c) <= F.col("q"))
        value = (low if c == "l" else high).alias(f"to_{c}")
        near = at.join(cover, [*keys, "b"]).filter(inside).select(*d.columns, value)
        return near.unionByName(d.join(tail, keys).filter(inside).select(*d.columns, F.col("low" if c == "l" else "high").alias(f"to_{c}")))

    moved = place(place(intervals, "l"), "r").filter("to_l <= to_r")
    return moved.select(*keys, *ident, F.col("to_l").alias("l"), F.col("to_r").alias("r"))


def common_gaps(runs: DataFrame, spans: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Site ranges that are gaps in all rows of a group: ``(group, l, r)`` from ``runs (*keys, gps, gln)``; what a row lacks up to the group's width counts as a gap.

    A running sum over the changes of depth, of which a group has no more than sites.
    """
    size = spans.groupBy(group).agg(F.count("*").alias("many"), F.max("width").cast("long").alias("whole"))
    tail = spans.join(size, group).select(group, F.col("width").cast("long").alias("gps"), (F.col("whole") - F.col("width")).alias("gln")).filter("gln > 0")
    all_ = runs.select(group, F.col("gps").cast("long").alias("gps"), F.col("gln").cast("long").alias("gln")).unionByName(tail)
    ends = all_.select(group, F.explode(F.array(F.struct((F.col("gps") + 1).alias("at"), F.lit(1).alias("k")), F.struct((F.col("gps") + F.col("gln") + 1).alias("at"), F.lit(-1).alias("k")))).alias("e"))
    change = ends.groupBy(group, "e.at").agg(F.sum("e.k").alias("k")).filter("k <> 0")
    w = W.partitionBy(group).orderBy("at")
    d = change.withColumn("deep", F.sum("k").over(w)).withColumn("r", F.lead("at").over(w) - 1).join(size, group)
    return d.filter("deep = many").select(group, F.col("at").alias("l"), "r")


def squeeze(ranges: DataFrame, spans: DataFrame, group: str) -> DataFrame:
    """The map from sites to sites without ``ranges``: the inverse of the one that inserts them."""
    width = spans.groupBy(group).agg(F.max("width").cast("long").alias("width"))
    gaps = ranges.select(group, (F.col("l") - 1).alias("gps"), (F.col("r") - F.col("l") + 1).alias("gln"))
    return inverse(from_gaps(gaps, width, [group]), [group])
