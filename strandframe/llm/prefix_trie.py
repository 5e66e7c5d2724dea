"""Trie of conversation prefixes with subtree sums by centroid decomposition.

**Rows.**  Turns become digests of (role, text) and are put in order by ranges of
(conversation, turn), so that a conversation of any length is dealt over tasks.  A
prefix is named by its length and a polynomial of its digests modulo 2^127 - 1;
partial polynomials of the ranges are joined by the two numbers that each range
leaves to the next.  Prefixes of rebuilt conversations follow from those of the
original ones by one product per turn.

**Nodes.**  One aggregate over prefixes gives members and, without any walk, the
weight of a subtree: a node weighs as many turns as run through it, so the subtree
of a node at depth d weighs the sum of its members' lengths from d on.

**Sums.**  The forest of parent edges is decomposed by centroids under these
weights.  A component's centroid is its deepest node that holds at least half of
the weight.  Removing it leaves the subtrees of its children and the part above;
the components' totals below it make its own sum, which is added to the nodes on the
path from the centroid to the top of its component, whose weights fall by the same
token.  Every step halves the weight, so there are as many as the logarithm of the
table.  Paths need no walk: the row of the centroid's smallest member at every
depth is the ancestor there.  Components up to ``limit`` in weight are finished by
the same steps over arrays, many components at a time.

Defined results: rows with null conversation id belong to none and are left out;
null turns come first, ties go by the digest of role and text, repeated rows are
turns of their own; null role or text is empty; a base conversation of remainder
zero is its own base; ``%`` takes the sign of the id; without conversations there
is no node, and a rebuilt conversation without turns is a member of the root alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut_lineage

P = 2**127 - 1
BASE = 0x5DEECE66D1B3A5C9F0E1D2C3B4A59687 % P
#: Nodes of smaller components are finished inside tasks; also the rows held there at once.
LIMIT = 100_000
#: The first turns that a conversation may take from its base.
HEAD = 5
#: Bytes of joined ids that one row carries to the digest.
BLOB = 1 << 16


def _raw(h: int) -> bytes:
    return h.to_bytes(16, "big")


def _int(b: bytes) -> int:
    return int.from_bytes(b, "big")


# ---- turns in order ------------------------------------------------------------------------------

RUNS = "conv long, part int, i long, before binary, here binary, n long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Polynomials of every run of one conversation inside a range."""
    conv, i, h = None, 0, 0
    for b in batches:
        out: tuple[list, list, list] = [], [], []
        for c, t in zip(b.column("conv").to_pylist(), b.column("t").to_pylist()):
            if c != conv:
                conv, i, h = c, 0, 0
            before, i = h, i + 1
            h = (h * BASE + int(t[:31], 16) + 1) % P
            for x, y in zip(out, (i, _raw(before), _raw(h))):
                x.append(y)
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("part"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary()), b.column("n")],
            names=["conv", "part", "i", "before", "here", "n"])


def ordered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, i, before, here, n)``: number of every turn from 1, polynomials without and with it, code points."""
    said, who = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256)
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("t"), F.length(said).cast("long").alias("n"))
    order = [F.col("conv"), F.asc_nulls_first("turn"), F.col("t")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.spark_partition_id().alias("part"), "t", "n")
    runs = cut_lineage(dealt.mapInArrow(_runs, RUNS))
    # two conversations per range: its first, which may have begun before it, and its last
    ends = runs.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max_by(F.struct("i", "here"), F.struct("conv", "i")).alias("end"))
    carry: dict[int, tuple[int, int, int]] = {}
    open_, count, h = None, 0, 0
    for r in sorted(ends.collect(), key=lambda r: r["part"]):
        if r["first"] == open_:
            carry[r["part"]] = (open_, count, h)
        same = r["first"] == open_ == r["last"]
        i, e = r["end"]["i"], _int(r["end"]["here"])
        count, h = (count + i, (h * pow(BASE, i, P) + e) % P) if same else (i, e)
        open_ = r["last"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {c: b.column(c).to_pylist() for c in ("conv", "part", "i", "before", "here")}
            for k, (c, part) in enumerate(zip(cols["conv"], cols["part"])):
                if part in carry and carry[part][0] == c:
                    _, add, front = carry[part]
                    i = cols["i"][k]
                    for name, step in (("before", i - 1), ("here", i)):
                        cols[name][k] = _raw((front * pow(BASE, step, P) + _int(cols[name][k])) % P)
                    cols["i"][k] = i + add
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), pa.array(cols["i"], pa.int64()), pa.array(cols["before"], pa.binary()), pa.array(cols["here"], pa.binary()), b.column("n")],
                names=["conv", "i", "before", "here", "n"])

    return runs.mapInArrow(joined, "conv long, i long, before binary, here binary, n long")


# ---- rebuilt conversations -----------------------------------------------------------------------

PREFIX = "conv long, d long, id binary, up binary, n long, size long"


def _named(d: int, h: int) -> bytes:
    return d.to_bytes(8, "big") + _raw(h)


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names of prefixes ``d`` whose polynomials get ``delta`` times the base's power."""
    power: dict[int, int] = {}
    for b in batches:
        ids, ups = [], []
        for d, before, here, delta, away in zip(*(b.column(c).to_pylist() for c in ("d", "before", "here", "delta", "away"))):
            x, u = _int(here), _int(before)
            if delta is not None and (shift := _int(delta)):
                for step in (away - 1, away):
                    if step not in power:
                        if len(power) > 100_000:
                            power.clear()
                        power[step] = pow(BASE, step, P)
                x, u = (x + shift * power[away]) % P, (u + shift * power.get(away - 1, pow(BASE, away - 1, P))) % P
            ids.append(_named(d, x))
            ups.append(_named(d - 1, u))
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("d"), pa.array(ids, pa.binary()), pa.array(ups, pa.binary()), b.column("n"), b.column("size")], names=["conv", "d", "id", "up", "n", "size"])


def prefixes(turns: DataFrame, modulus: int = 100, head: int = HEAD + 1) -> tuple[DataFrame, DataFrame]:
    """Prefixes ``(conv, d, id, up, n, size)`` of rebuilt conversations, d >= 1, and ``(conv, size)`` of all of them."""
    first = F.when(F.col("i") < head, F.struct("i", "before", "here", "n"))
    own = turns.groupBy("conv").agg(F.max("i").alias("len"), F.array_sort(F.collect_list(first)).alias("head"))  # head - 1 turns at most
    own = cut_lineage(own.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % head).cast("int")))
    base = own.select(F.col("conv").alias("base"), F.col("head").alias("from"))
    both = own.withColumn("base", F.col("conv") - F.col("conv") % modulus).join(base, "base", "left")
    both = both.withColumn("from", F.slice(F.coalesce("from", F.array().cast(dict(base.dtypes)["from"])), F.lit(1), F.col("h")))
    k, rest = F.size("from").cast("long"), F.greatest(F.lit(0), F.col("len") - F.col("h"))
    zero = F.lit(_raw(0))
    last = F.when(F.size("from") > 0, F.element_at("from", -1)["here"]).otherwise(zero)
    cut = F.when((F.col("h") > 0) & (F.col("len") >= F.col("h")), F.get("head", F.col("h") - 1)["here"]).otherwise(zero)
    both = both.select("conv", "h", "from", k.alias("k"), (k + rest).alias("size"), last.alias("last"), cut.alias("cut"))
    both = cut_lineage(both.mapInArrow(_delta, "conv long, h int, k long, size long, delta binary, from array<struct<i:long,before:binary,here:binary,n:long>>"))
    none = [F.lit(None).cast("binary").alias("delta"), F.lit(0).cast("long").alias("away")]
    taken = both.select("conv", "size", F.explode("from").alias("x")).select("conv", F.col("x.i").alias("d"), "x.before", "x.here", *none, "x.n", "size")
    later = turns.join(both.drop("from"), "conv").filter("i > h")
    later = later.select("conv", (F.col("i") - F.col("h") + F.col("k")).alias("d"), "before", "here", "delta", (F.col("i") - F.col("h")).alias("away"), "n", "size")
    return cut_lineage(taken.unionByName(later).mapInArrow(_moved, PREFIX)), both.select("conv", "size")


def _delta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        delta = [_raw((_int(x) - _int(y)) % P) for x, y in zip(b.column("last").to_pylist(), b.column("cut").to_pylist())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "h", "k", "size")), pa.array(delta, pa.binary()), b.column("from")], names=["conv", "h", "k", "size", "delta", "from"])


# ---- subtree sums --------------------------------------------------------------------------------

def centroid_sums(up: np.ndarray, depth: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums of ``own`` (one column per sum) over the subtrees of a forest; ``up`` is the parent's place or the node itself.

    ``weight`` holds subtree weights, positive at every node.
    """
    n = len(up)
    up, weight, acc, out = up.copy(), weight.copy(), np.zeros_like(own), np.zeros_like(own)
    comp, alive = _tops(up), np.arange(n)
    while len(alive):
        c = comp[alive]
        half = alive[2 * weight[alive] >= weight[c]]
        half = half[np.argsort(depth[half], kind="stable")]
        at = np.full(n, -1)
        at[comp[half]] = half  # the deepest comes last
        tops = np.unique(c)
        cent = at[tops]
        # the parts below the centroids fall off, then the centroids
        new_up = up.copy()
        new_up[cent] = cent
        is_cent = np.zeros(n, bool)
        is_cent[cent] = True
        loose = alive[is_cent[up[alive]] & ~is_cent[alive]]
        boss = up[loose].copy()
        new_up[loose] = loose
        label = _tops(new_up)
        total = np.zeros_like(own)
        np.add.at(total, label[alive], own[alive])
        found = own[cent].copy()
        place = np.full(n, -1)
        place[cent] = np.arange(len(cent))
        np.add.at(found, place[boss], total[loose])
        out[cent] = acc[cent] + found
        # the path from each centroid to the top of its component
        walk, who = up[cent], np.flatnonzero(up[cent] != cent)
        walk = walk[who]
        while len(walk):
            acc[walk] += found[who]
            weight[walk] -= weight[cent[who]]
            on = up[walk] != walk
            walk, who = up[walk[on]], who[on]
        up, comp = new_up, label
        alive = alive[~is_cent[alive]]
    return out


def _tops(up: np.ndarray) -> np.ndarray:
    while True:
        ahead = up[up]
        if np.array_equal(ahead, up):
            return up
        up = ahead


SUMS = "id binary, leaves long, saved long"


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whole components, which come one after the other."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if rows + b.num_rows > LIMIT and b.num_rows:  # what is whole goes; a component goes on from batch to batch
            held.append(b)
            t = pa.Table.from_batches(held)
            comp = t.column("comp").combine_chunks()
            cut = t.num_rows
            while cut and comp[cut - 1].as_py() == comp[t.num_rows - 1].as_py():
                cut -= 1
            if cut:
                yield from _solved(t.slice(0, cut)).to_batches()
            held = t.slice(cut).combine_chunks().to_batches()
            rows = t.num_rows - cut
        else:
            held.append(b)
            rows += b.num_rows
    if rows:
        yield from _solved(pa.Table.from_batches(held)).to_batches()


def _solved(t: pa.Table) -> pa.Table:
    ids = t.column("id").to_pylist()
    at = {x: i for i, x in enumerate(ids)}
    tops = t.column("comp").to_pylist()
    up = np.array([i if x == c else at[u] for i, (x, c, u) in enumerate(zip(ids, tops, t.column("up").to_pylist()))], np.int64)
    col = lambda c: t.column(c).to_numpy()
    own = np.stack([col("leaf"), col("save")], axis=1)
    s = centroid_sums(up, col("d"), col("w"), own)
    return pa.table([t.column("id"), pa.array(s[:, 0] + col("add_leaf")), pa.array(s[:, 1] + col("add_save"))], names=["id", "leaves", "saved"])


def subtree_sums(nodes: DataFrame, rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(id, leaves, saved)`` from nodes ``(id, up, conv, d, w, leaf, save)`` of one tree and prefixes ``(conv, d, id, up)``, d >= 0."""
    zero = F.lit(0).cast("long")
    live = nodes.select("id", "up", "conv", "d", "w", "leaf", "save", zero.alias("add_leaf"), zero.alias("add_save"), F.lit(_named(0, 0)).alias("comp"))
    small, done = [], []
    while True:
        total = live.groupBy("comp").agg(F.max("w").alias("total"))  # the top's
        live = cut_lineage(live.join(total, "comp"))
        small.append(live.filter(F.col("total") <= limit).drop("total"))
        live = live.filter(F.col("total") > limit)
        if live.isEmpty():
            break
        cent = live.filter("2 * w >= total").groupBy("comp").agg(F.max_by(F.struct("id", "conv", "d", "w"), "d").alias("c")).select("comp", F.col("c.id").alias("cid"), F.col("c.conv").alias("cconv"), F.col("c.d").alias("cd"), F.col("c.w").alias("cw"))
        cent = cut_lineage(cent)
        deeper = rows.select("conv", F.col("d").alias("at"), F.col("id").alias("child"), F.col("up").alias("cid2"))
        side = live.join(cent, "comp").withColumn("at", F.col("cd") + 1).join(deeper, ["conv", "at"], "left")
        below = (F.col("d") > F.col("cd")) & F.coalesce(F.col("cid2") == F.col("cid"), F.lit(False))
        side = side.withColumn("side", F.when(F.col("id") == F.col("cid"), 0).when(below, 1).otherwise(2))
        side = cut_lineage(side.drop("at", "cid2", "cconv", "cd", "total"))
        sub = side.filter("side < 2").groupBy("comp").agg(F.sum("leaf").alias("sub_leaf"), F.sum("save").alias("sub_save"))
        path = cent.select("comp", F.col("cconv").alias("conv"), "cd").join(rows.select("conv", "d", "id"), "conv").filter("d < cd").select("comp", "id", F.lit(True).alias("hit"))
        new = side.join(sub, "comp")
        done.append(new.filter("side = 0").select("id", (F.col("add_leaf") + F.col("sub_leaf")).alias("leaves"), (F.col("add_save") + F.col("sub_save")).alias("saved")))
        same = ["id", "up", "conv", "d"]
        lower = side.filter("side = 1").select(*same, "w", "leaf", "save", "add_leaf", "add_save", F.col("child").alias("comp"))
        upper = new.filter("side = 2").join(path, ["comp", "id"], "left")
        hit = F.coalesce("hit", F.lit(False))
        upper = upper.select(*same, (F.col("w") - F.when(hit, F.col("cw")).otherwise(0)).alias("w"), "leaf", "save",
                             (F.col("add_leaf") + F.when(hit, F.col("sub_leaf")).otherwise(0)).alias("add_leaf"),
                             (F.col("add_save") + F.when(hit, F.col("sub_save")).otherwise(0)).alias("add_save"), "comp")
        live = lower.unionByName(upper)
    rest = reduce(DataFrame.unionByName, small)
    rest = rest.repartition("comp").sortWithinPartitions("comp").mapInArrow(_finished, SUMS)
    return reduce(DataFrame.unionByName, done, rest)


# ---- digests of members that end at a node ----------------------------------------------------------

def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined ids of consecutive rows of a node."""
    node, first, ids, size = None, 0, [], 0
    for b in batches:
        out: tuple[list, list, list] = [], [], []
        for x, c in zip(b.column("id").to_pylist(), b.column("conv").to_pylist()):
            if node is not None and (x != node or size > BLOB):
                for y, z in zip(out, (node, first, ",".join(ids))):
                    y.append(z)
                node = None
            if node is None:
                node, first, ids, size = x, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.binary(), pa.int64(), pa.string()))], names=["id", "first", "ids"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["id", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, h = None, None
    for b in batches:
        out: tuple[list, list] = [], []
        for x, ids in zip(b.column("id").to_pylist(), b.column("ids").to_pylist()):
            if x != node:
                if node is not None:
                    out[0].append(node)
                    out[1].append(h.hexdigest())
                node, h = x, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], names=["id", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=["id", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``(id, ends_sha256)`` of rows ``(id, conv)``: blocks of joined ids first, so that a node with very many takes few rows."""
    dealt = ends.repartitionByRange("id", "conv").sortWithinPartitions("id", "conv")
    blobs = dealt.mapInArrow(_blobs, "id binary, first long, ids string")
    return blobs.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id binary, ends_sha256 string")


# ---- the trie ------------------------------------------------------------------------------------

def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per distinct prefix of rebuilt conversations: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``."""
    turns = cut_lineage(ordered_turns(conversations, conv, turn, role, text))
    later, sizes = prefixes(turns)
    root = F.lit(_named(0, 0))
    at_root = sizes.select("conv", F.lit(0).cast("long").alias("d"), root.alias("id"), F.lit(None).cast("binary").alias("up"), F.lit(0).cast("long").alias("n"), "size")
    rows = later.unionByName(at_root)
    nodes = rows.groupBy("id").agg(
        F.first("d").alias("d"), F.first("up").alias("up"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("n").alias("n"), F.sum(F.col("size") - F.col("d") + 1).alias("w"))
    nodes = cut_lineage(nodes)
    children = nodes.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    nodes = cut_lineage(nodes.join(children, "id", "left").withColumn("leaf", leaf).withColumn("save", (F.col("n_convs") - 1) * F.col("n")))
    sums = subtree_sums(nodes, rows, limit)
    parent = nodes.select(F.col("id").alias("up"), F.col("conv").alias("parent_conv_id"))
    ends = end_digests(rows.filter("d = size").select("id", "conv"))
    out = nodes.join(sums, "id").join(ends, "id", "left").join(parent, "up", "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"))
