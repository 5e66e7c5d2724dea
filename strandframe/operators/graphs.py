"""Sparse similarity graphs: edge lists, components, single-linkage forests.

Every step is a join or an aggregate on vertex ids; the loop count grows with
the logarithm of the component size and each round is cut off by a reliable
checkpoint.  A graph, or what contraction has left of it, that has no more than
``FINISH`` edges is finished in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut_lineage

#: Parts of a node's neighbours that are reduced apart.
PARTS = 64
#: Edges of a contracted graph that one task finishes; a larger one goes on in rounds.
FINISH = 500_000


def edge_list(rows: DataFrame, threshold: float, order: list[str], similarity: bool = False) -> DataFrame:
    """Edges ``(u, v, dist)`` with u < v from ``(u, v, value)`` rows.

    Keeps values up to ``threshold`` (from it when they are similarities, which
    become ``max - value``); the first of duplicate pairs by ``order`` wins.
    """
    kept = rows.filter(F.col("value") >= threshold if similarity else F.col("value") <= threshold).filter("u <> v")
    kept = kept.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "value", *order)
    first = kept.groupBy("a", "b").agg(F.min_by("value", F.struct(*order, "value")).alias("value"))
    if similarity:
        top = first.agg(F.max("value").alias("top"))
        first = first.join(F.broadcast(top)).withColumn("value", F.col("top") - F.col("value"))
    return first.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("value").cast("double").alias("dist"))


def _fingerprint(df: DataFrame):
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """``(u, m)``: the smallest ``v`` of every ``u``, by parts of its neighbours first, so that a hub's edges meet in no task."""
    part = F.pmod(F.hash("v"), F.lit(PARTS)).alias("part")
    return pairs.groupBy("u", part).agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` with the smallest node id as label, by alternating star rounds."""
    e = cut_lineage(edges.select("u", "v").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        # large star: neighbours above a node hang on the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both).select("u", F.least("m", "u").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its lower neighbours hang on the smallest of them
        low = _least(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _join(parent: dict[int, int], a: int, b: int) -> bool:
    """Unite two nodes under the smaller root; whether they were apart."""
    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    a, b = root(a), root(b)
    parent[max(a, b)] = min(a, b)
    return a != b


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges that sorted merging keeps of those in one task; contracted ends are ``cu`` and ``cv``."""
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is not None:
        table = table.sort_by([(c, "ascending") for c in ("dist", "u", "v")])
        parent: dict[int, int] = {}
        kept = [_join(parent, a, b) for a, b in zip(table.column("cu").to_pylist(), table.column("cv").to_pylist())]
        yield from table.filter(pa.array(kept, pa.bool_())).to_batches()


def small_components(edges: DataFrame) -> DataFrame:
    """``components`` of at most ``FINISH`` edges, in one task."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}
        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _join(parent, u, v)
        low: dict[int, int] = {}
        for x in sorted(parent):  # a root is smaller than what hangs on it
            low[x] = x if parent[x] == x else low[parent[x]]
        yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int64()), pa.array(list(low.values()), pa.int64())], ["node", "component"])

    longs = edges.filter("u <> v").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    return longs.coalesce(1).mapInArrow(label, "node long, component long")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest ``(u, v, dist)``: what sorted single-linkage merging keeps.

    Each round every component picks its lightest outgoing edge (ties by vertex
    ids, so the choice is unique) and components joined by picks merge. What is
    lighter among edges of the same two components stands for them. Once ``FINISH``
    edges or fewer are left, one task merges them in sorted order.
    """
    rest = cut_lineage(edges.select("u", "v", "dist", F.col("u").alias("cu"), F.col("v").alias("cv")))
    chosen = None
    while left := rest.count():
        if left <= FINISH:
            last = cut_lineage(rest.coalesce(1).mapInArrow(_kruskal, rest.schema))
            chosen = last if chosen is None else chosen.select(last.columns).unionByName(last)
            break
        sides = rest.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("dist", "u", "v", "cu", "cv").alias("e"))
        picks = cut_lineage(sides.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.*"))
        kept = picks.drop("c").distinct()
        chosen = kept if chosen is None else chosen.unionByName(kept)
        label = _merge_labels(picks)
        a = label.select(F.col("node").alias("cu"), F.col("component").alias("nu"))
        b = label.select(F.col("node").alias("cv"), F.col("component").alias("nv"))
        rest = cut_lineage(
            rest.join(a, "cu", "left").join(b, "cv", "left")
            .select("u", "v", "dist", F.coalesce("nu", "cu").alias("cu"), F.coalesce("nv", "cv").alias("cv")).filter("cu <> cv")
            .groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min(F.struct("dist", "u", "v", "cu", "cv")).alias("e")).select("e.u", "e.v", "e.dist", "e.cu", "e.cv")
        )
    return edges.select("u", "v", "dist").limit(0) if chosen is None else chosen.select("u", "v", "dist")


def _merge_labels(picks: DataFrame) -> DataFrame:
    """``(node, component)`` of components joined by their picks, by pointer jumping.

    Following picks ends in one mutual pair per merged component (the order of
    edges is total); the smaller of the two becomes the root.
    """
    target = F.when(F.col("c") == F.col("cu"), F.col("cv")).otherwise(F.col("cu"))
    to = picks.select("c", target.alias("p"))
    back = to.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    root = (F.col("pp") == F.col("c")) & (F.col("c") < F.col("p"))
    jump = cut_lineage(to.join(back, "p", "left").select("c", F.when(root, F.col("c")).otherwise(F.col("p")).alias("p")))
    while True:
        ahead = jump.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        step = cut_lineage(jump.join(ahead, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
        jump = step.select("c", "p")
        if step.filter("moved").isEmpty():
            return jump.select(F.col("c").alias("node"), F.col("p").alias("component"))


def forest_report(forest: DataFrame) -> DataFrame:
    """Trees of a forest: ``(component, size, height, length)``."""
    forest = cut_lineage(forest)
    label = cut_lineage(small_components(forest) if forest.count() <= FINISH else components(forest))
    size = label.groupBy("component").agg(F.count("*").alias("size"))
    d = forest.join(label.withColumnRenamed("node", "u"), "u").groupBy("component").agg(F.max("dist").alias("height"), F.sum("dist").alias("length"))
    return size.join(d, "component")


def representatives(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One member per single-link cluster: smallest distance sum to its neighbours, then smallest id."""
    label = components(edges)
    both = edges.select("u", "dist").unionByName(edges.select(F.col("v").alias("u"), "dist"))
    sums = both.groupBy("u").agg(F.sum("dist").alias("total"))
    d = label.join(sums, label["node"] == sums["u"], "left").groupBy("component").agg(
        F.min_by("node", F.struct("total", "node")).alias("node"), F.count("*").alias("members")
    )
    single = nodes.join(label.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"), F.lit(1).cast("long").alias("members"))
    return d.select("node", "component", "members").unionByName(single)
