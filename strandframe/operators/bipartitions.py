"""Regions of alignments over the splits of a tree of their members.

A tree is given by memberships ``(msa_id, member, node, level, side)``: every inner
node above a member and on which side of it the member is.  Letters are counted per
node, site and letter, so both sides of a split come from one count and the total;
no pair of members is made.

What is made of cells or sites is joined by shuffles (``by_key``): the optimizer takes
it for the bytes of the texts, and would send it through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.operators import alignment_sets as L
from strandframe.operators.alignment_columns import cells_of, scoring_segments
from strandframe.session import cut_lineage


def by_key(d: DataFrame) -> DataFrame:
    return d.hint("merge")


def binary_tree(rows: DataFrame, levels: int) -> DataFrame:
    """Memberships of the binary tree over member numbers: two members meet where their numbers' upper bits agree.  Nodes with members on one side only are left out."""
    up = rows.select("msa_id", "member", F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level"))
    d = up.select("msa_id", "member", "level", F.expr("shiftright(member, level)").alias("q"), F.expr("shiftright(member, level - 1) & 1").cast("int").alias("side"))
    d = d.select("msa_id", "member", (F.col("level") * F.lit(2**40) + F.col("q")).alias("node"), "level", "side")
    both = d.groupBy("msa_id", "node").agg(F.min("side").alias("a"), F.max("side").alias("b")).filter("a < b").select("msa_id", "node")
    return d.join(both, ["msa_id", "node"])


def splits(cells: DataFrame, tree: DataFrame) -> DataFrame:
    """``(msa_id, member, node)``: the subtrees of inner nodes but the root's, and single members (node -1 - member)."""
    inner = tree.select("msa_id", "member", "node")
    top = tree.groupBy("msa_id").agg(F.max("level").alias("level")).join(by_key(tree.select("msa_id", "node", "level").distinct()), ["msa_id", "level"]).select("msa_id", "node")
    members = cells.select("msa_id", "member").distinct()
    sides = inner.join(by_key(top), ["msa_id", "node"], "left_anti").unionByName(members.select("msa_id", "member", (-1 - F.col("member")).alias("node")))
    many = members.groupBy("msa_id").agg(F.count("*").alias("n")).filter("n > 1").select("msa_id")
    return sides.join(by_key(many), "msa_id")


def split_scores(cells: DataFrame, sides: DataFrame, match: int = 4, other: int = -1) -> DataFrame:
    """``(msa_id, node, site, score)``: for every split, a site where both sides have a letter in common scores ``match``."""
    letters = cells.filter("r != '-'")
    total = letters.groupBy("msa_id", "site", "r").agg(F.count("*").alias("n"))
    own = letters.select("msa_id", "member", "site", "r").join(by_key(sides), ["msa_id", "member"]).groupBy("msa_id", "node", "site", "r").agg(F.count("*").alias("k"))
    hit = own.join(by_key(total), ["msa_id", "site", "r"]).filter("k < n").select("msa_id", "node", "site").distinct().withColumn("score", F.lit(match).cast("long"))
    width = cells.groupBy("msa_id").agg(F.max("site").alias("width"))
    grid = sides.select("msa_id", "node").distinct().join(by_key(width), "msa_id").select("msa_id", "node", F.explode(F.sequence(F.lit(1).cast("long"), "width")).alias("site"))
    return grid.join(by_key(hit), ["msa_id", "node", "site"], "left").fillna(other, ["score"])


def common_regions(cells: DataFrame, tree: DataFrame, threshold: int, match: int = 4, other: int = -1) -> DataFrame:
    """``(msa_id, l, r, conserved)``: site ranges that lie in conserved segments of every split, and the rest of the sites.

    Depth of segments by changes: a range has as many as there are splits.
    """
    sides = cut_lineage(splits(cells, tree))
    scores = split_scores(cells, sides, match, other)
    key = F.struct("msa_id", "node")
    segments = scoring_segments(scores.select(key.alias("msa_id"), "site", "score"), threshold).select("msa_id.msa_id", "msa_id.node", "l", "r")
    count = sides.select("msa_id", "node").distinct().groupBy("msa_id").agg(F.count("*").alias("splits"))
    width = cells.groupBy("msa_id").agg(F.max("site").alias("width")).join(by_key(count.select("msa_id")), "msa_id")
    ends = segments.select("msa_id", F.explode(F.array(F.struct(F.col("l").alias("at"), F.lit(1).alias("k")), F.struct((F.col("r") + 1).alias("at"), F.lit(-1).alias("k")))).alias("e")).select("msa_id", "e.at", "e.k")
    ends = ends.unionByName(width.select("msa_id", F.explode(F.array(F.lit(1).cast("long"), F.col("width") + 1)).alias("at"), F.lit(0).alias("k")))
    w = W.partitionBy("msa_id").orderBy("at")  # changes of one alignment: no more than its sites
    d = ends.groupBy("msa_id", "at").agg(F.sum("k").alias("k")).withColumn("deep", F.sum("k").over(w)).withColumn("next", F.lead("at").over(w))
    d = d.join(by_key(count), "msa_id").withColumn("conserved", F.col("deep") == F.col("splits")).filter("next IS NOT NULL")
    new = F.when(F.col("conserved") == F.lag("conserved").over(w), 0).otherwise(1)
    d = d.withColumn("new", new).withColumn("g", F.sum("new").over(w))
    return d.groupBy("msa_id", "g", "conserved").agg(F.min("at").alias("l"), (F.max("next") - 1).alias("r")).select("msa_id", "l", "r", "conserved")


def regions(rows: DataFrame, tree: DataFrame, threshold: int, match: int = 4, other: int = -1, alone: int = L.ALONE) -> DataFrame:
    """``common_regions`` of rows ``(msa_id, member, a)``: whole alignments with their trees in kernels, larger ones cell by cell."""
    nodes = tree.groupBy("msa_id", "member").agg(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("level").cast("long").alias("level"))).alias("nodes"))
    d = by_key(rows.select("msa_id", "member", "a")).join(by_key(nodes), ["msa_id", "member"], "left")

    def kernel(t: pa.Table) -> pa.Table:
        x = L.letters(t)
        size = np.array([len(a or "") for a in t["a"].to_pylist()], np.int64)
        width = np.zeros(len(x.sets), np.int64)
        np.maximum.at(width, x.of, size)
        # members with sites, those without a number as one that has no letters of its own
        known = t["member"].is_valid().to_numpy()
        member = t["member"].fill_null(0).to_numpy()
        there = np.flatnonzero(size > 0)
        one, which = np.unique(np.stack([x.of, known, member])[:, there], axis=1, return_inverse=True)
        several = np.bincount(one[0], minlength=len(x.sets)) > 1
        lists = t["nodes"].combine_chunks()
        flat, row = lists.flatten(), np.repeat(np.arange(t.num_rows), np.array(lists.value_lengths().fill_null(0)))
        label, level = (flat.field(c).to_numpy() for c in ("node", "level"))
        top = np.full(len(x.sets), -(2**62))
        np.maximum.at(top, x.of[row], level)
        highest = np.unique(np.stack([x.of[row], label])[:, level == top[x.of[row]]], axis=1)
        pair, node = np.unique(np.concatenate([highest, np.stack([x.of[row], label])], axis=1), axis=1, return_inverse=True)
        node = node.reshape(-1)
        lower = np.ones(len(pair[0]), bool)
        lower[node[: len(highest[0])]] = False
        node = node[len(highest[0]):]
        kept = lower[node] & several[x.of[row]]
        own = several[one[0]]
        # splits: inner nodes below the top, then single members; letters are counted as often as a row is named
        split = np.concatenate([node[kept], len(pair[0]) + which.reshape(-1)])
        row = np.concatenate([row[kept], there])
        mine = np.concatenate([np.ones(kept.sum(), bool), own[which.reshape(-1)]])
        count = np.concatenate([np.ones(kept.sum(), bool), known[there]])
        split, row, count = split[mine], row[mine], count[mine]
        _, split = np.unique(split, return_inverse=True)
        of = np.zeros(split.max(initial=-1) + 1, np.int64)
        of[split] = x.of[row]
        order = np.argsort(split[count], kind="stable")
        deep = _depth(x, row[count][order], split[count][order], of, width, threshold, match, other)
        need = np.bincount(of, minlength=len(x.sets))
        column = np.repeat(np.arange(len(x.sets)), width)
        site = np.arange(len(column)) - np.repeat(x.first, width) + 1
        full = deep == need[column]
        shown = np.flatnonzero(several[column])
        column, site, full = column[shown], site[shown], full[shown]
        begins = np.ones(len(shown), bool)
        begins[1:] = (column[1:] != column[:-1]) | (full[1:] != full[:-1])
        at = np.flatnonzero(begins)
        ends = np.append(at[1:], len(shown))[: len(at)] - 1
        return pa.table({"msa_id": x.sets.take(pa.array(column[at])), "l": site[at], "r": site[ends], "conserved": full[at]})

    def larger(huge: DataFrame) -> DataFrame:
        of = tree.join(by_key(huge.select("msa_id").distinct()), "msa_id", "left_semi")
        return common_regions(cells_of(huge.select("msa_id", "member", "a")), of, threshold, match, other)

    return L.by_alignment(d, kernel, "msa_id long, l long, r long, conserved boolean", larger, alone)


def _depth(x: L.Letters, row: np.ndarray, split: np.ndarray, of: np.ndarray, width: np.ndarray, threshold: int, match: int, other: int) -> np.ndarray:
    """In how many splits' segments every column is; memberships come in the order of splits, ``of`` is the alignment of each."""
    change = np.zeros(int(width.sum()) + 1, np.int64)
    wide = width[of]
    ends = np.searchsorted(split, np.arange(len(of) + 1))
    starts = np.searchsorted(x.row, np.arange(len(x.of) + 1))
    letters = np.diff(starts)[row]
    _, which, n = x.same()
    total = n[which.reshape(-1)]
    cost = np.concatenate([[0], np.cumsum(wide + np.bincount(split, letters, len(of)).astype(np.int64))])
    a = 0
    while a < len(of):
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + NODE_CELLS, "right")) - 1)
        own = slice(ends[a], ends[b])
        many = letters[own]
        at = np.repeat(starts[row[own]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        part = np.repeat(split[own] - a, many)
        base = np.cumsum(wide[a:b]) - wide[a:b]
        site = x.column[at] - x.first[of[a + part]] + base[part]
        kinds, code = np.unique(x.code[at], return_inverse=True)
        _, first, k = np.unique(site * max(len(kinds), 1) + code.reshape(-1), return_index=True, return_counts=True)
        score = np.full(int(wide[a:b].sum()), other, np.int64)
        score[site[first[k < total[at[first]]]]] = match
        part, l, r = _segments(score, wide[a:b], threshold)
        column = x.first[of[a + part]]
        np.add.at(change, column + l, 1)
        np.add.at(change, column + r + 1, -1)
        a = b
    return np.cumsum(change)[:-1]


def _segments(score: np.ndarray, width: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``scoring_segments`` of lines of scores, site by site for all of them: line, first and last site (from 0)."""
    order = np.argsort(-width, kind="stable")
    base = (np.cumsum(width) - width)[order]
    live = np.searchsorted(-width[order], -np.arange(width.max(initial=0)))  # lines with more sites than that
    s, most, l, r = (np.zeros(len(width), np.int64) for _ in range(4))
    found = []
    for at, n in enumerate(live):
        v = score[base[:n] + at]
        l[:n][(s[:n] == 0) & (v > 0)] = at
        raw = s[:n] + v
        now = np.maximum(raw, 0)
        better = (raw >= threshold) & (raw > most[:n])
        most[:n][better] = raw[better]
        r[:n][better] = at
        close = np.flatnonzero((most[:n] > 0) & ((now <= 0) | (now < most[:n] - threshold)))
        if len(close):
            found.append((order[close], l[close], r[close]))
            now[close] = 0
            most[close] = 0
        s[:n] = now
    close = np.flatnonzero(most > 0)
    found.append((order[close], l[close], r[close]))
    return tuple(np.concatenate(x) for x in zip(*found))


def fused_groups(cells: DataFrame, tree: DataFrame, threshold: int, match: int = 4, other: int = -1) -> DataFrame:
    """``(msa_id, member, node, size)``: members joined as long as no stretch between a node's two sides scores under ``-threshold``.

    A node that may not be fused keeps all above it from being fused; every member
    belongs to its highest node that may (node -1 - member if there is none).
    """
    letters = cells.filter("r != '-'").select("msa_id", "member", "site", "r")
    met = letters.join(by_key(tree), ["msa_id", "member"]).groupBy("msa_id", "node", "site", "r").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    hit = met.filter("a < b").select("msa_id", "node", "site").distinct().withColumn("score", F.lit(match).cast("long"))
    width = cells.groupBy("msa_id").agg(F.max("site").alias("width"))
    nodes = tree.groupBy("msa_id", "node").agg(F.max("level").alias("level"), F.min("member").alias("rep"))
    grid = nodes.join(by_key(width), "msa_id").select("msa_id", "node", F.explode(F.sequence(F.lit(1).cast("long"), "width")).alias("site"))
    line = grid.join(by_key(hit), ["msa_id", "node", "site"], "left").fillna(other, ["score"])
    ordered = F.array_sort(F.collect_list(F.struct("site", "score")))  # one row's width
    zero = F.lit(0).cast("long")
    run = F.aggregate(ordered, F.struct(zero.alias("s"), zero.alias("low")), lambda a, x: F.struct(
        F.least(a["s"] + x["score"], zero).alias("s"), F.least(a["low"], a["s"] + x["score"]).alias("low")), lambda a: a["low"])
    bad = line.groupBy("msa_id", "node").agg(run.alias("low")).filter(F.col("low") < -threshold).join(by_key(nodes), ["msa_id", "node"])
    above = bad.select("msa_id", F.col("rep").alias("member"), F.col("level").alias("from")).join(by_key(tree), ["msa_id", "member"]).filter(F.col("level") >= F.col("from"))
    free = tree.join(by_key(above.select("msa_id", "node").distinct()), ["msa_id", "node"], "left_anti")
    best = free.groupBy("msa_id", "member").agg(F.max_by("node", "level").alias("node"))
    d = cells.select("msa_id", "member").distinct().join(by_key(best), ["msa_id", "member"], "left").withColumn("node", F.coalesce("node", -1 - F.col("member")))
    size = d.groupBy("msa_id", "node").agg(F.count("*").alias("size"))
    return d.join(by_key(size), ["msa_id", "node"]).select("msa_id", "member", "node", "size")


#: Letters and sites of nodes that a kernel compares at once; a larger node alone.
NODE_CELLS = 1_000_000


def fused_members(rows: DataFrame, tree: DataFrame, threshold: int, match: int = 4, other: int = -1, alone: int = L.ALONE) -> DataFrame:
    """``fused_groups`` of rows ``(msa_id, member, a)``: whole alignments with their trees in kernels, larger ones cell by cell."""
    nodes = tree.groupBy("msa_id", "member").agg(F.collect_set(F.struct(F.col("node").cast("long").alias("node"), F.col("level").cast("long").alias("level"), F.col("side").cast("long").alias("side"))).alias("nodes"))
    d = by_key(rows.select("msa_id", "member", "a")).join(by_key(nodes), ["msa_id", "member"], "left")

    def kernel(t: pa.Table) -> pa.Table:
        x = L.letters(t)
        size = np.array([len(a or "") for a in t["a"].to_pylist()], np.int64)
        width = np.zeros(len(x.sets), np.int64)
        np.maximum.at(width, x.of, size)
        known = t["member"].is_valid().to_numpy()
        member = t["member"].fill_null(0).to_numpy()
        lists = t["nodes"].combine_chunks()
        many = np.array(lists.value_lengths().fill_null(0))
        flat, row = lists.flatten(), np.repeat(np.arange(t.num_rows), many)
        label, level, side = (flat.field(c).to_numpy() for c in ("node", "level", "side"))
        # nodes of all alignments numbered through, and memberships in their order
        pair, node = np.unique(np.stack([x.of[row], label]), axis=1, return_inverse=True)
        node = node.reshape(-1)
        order = np.argsort(node, kind="stable")
        row, node, level, side = row[order], node[order], level[order], side[order]
        low = _lowest(x, row, node, side, width[pair[0]], match, other)
        top = np.full(len(low), -(2**62))
        np.maximum.at(top, node, level)
        first = np.full(len(low), 2**62)
        np.minimum.at(first, node, member[row])
        # a bad node keeps all from its level on above its first member
        one, which = np.unique(np.stack([x.of, member]), axis=1, return_inverse=True)
        which = which.reshape(-1)
        limit = np.full(len(one[0]), 2**62)
        marks = (low < -threshold)[node] & (member[row] == first[node])
        np.minimum.at(limit, which[row[marks]], top[node[marks]])
        kept = np.ones(len(low), bool)
        kept[node[level >= limit[which[row]]]] = False
        free = np.flatnonzero(kept[node])
        free = free[np.argsort(level[free], kind="stable")]
        best = -1 - one[1]
        best[which[row[free]]] = pair[1][node[free]]  # the highest comes last
        there = np.unique(which[known & (size > 0)])
        of, group = one[0][there], best[there]
        _, same, n = np.unique(np.stack([of, group]), axis=1, return_inverse=True, return_counts=True)
        return pa.table({"msa_id": x.sets.take(pa.array(of)), "member": one[1][there], "node": group, "size": n[same.reshape(-1)]})

    def larger(huge: DataFrame) -> DataFrame:
        of = huge.select("msa_id", "member", F.inline("nodes"))
        return fused_groups(cells_of(huge.select("msa_id", "member", "a")), of, threshold, match, other)

    return L.by_alignment(d, kernel, "msa_id long, member long, node long, size long", larger, alone)


def _lowest(x: L.Letters, row: np.ndarray, node: np.ndarray, side: np.ndarray, width: np.ndarray, match: int, other: int) -> np.ndarray:
    """Lowest score of a stretch of sites between the sides of every node, 0 at most; memberships come in the order of nodes, ``width`` is by node."""
    out = np.zeros(len(width), np.int64)
    ends = np.searchsorted(node, np.arange(len(width) + 1))
    starts = np.searchsorted(x.row, np.arange(len(x.of) + 1))
    letters = np.diff(starts)[row]
    cost = np.concatenate([[0], np.cumsum(width + np.bincount(node, letters, len(width)).astype(np.int64))])
    a = 0
    while a < len(width):
        b = max(a + 1, int(np.searchsorted(cost, cost[a] + NODE_CELLS, "right")) - 1)
        own = slice(ends[a], ends[b])
        wide = width[a:b]
        base = np.cumsum(wide) - wide
        many = letters[own]
        at = np.repeat(starts[row[own]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        entry = np.repeat(np.arange(ends[a], ends[b]), many)
        site = x.column[at] - x.first[x.of[row[entry]]] + base[node[entry] - a]
        kinds, code = np.unique(x.code[at], return_inverse=True)
        sides, which = np.unique(side[entry], return_inverse=True)
        met = np.unique((site * len(kinds) + code) * len(sides) + which) // max(len(sides), 1)
        hit = met[1:][met[1:] == met[:-1]] // max(len(kinds), 1)  # one letter on two sides
        score = np.full(int(wide.sum()), other, np.int64)
        score[hit] = match
        full = wide > 0
        if full.any():
            wide, base = wide[full], base[full]
            total = np.concatenate([[0], np.cumsum(score)])
            line = total[1:] - np.repeat(total[base], wide)
            # no running maximum reaches into the next line
            apart = np.repeat(np.arange(len(wide)) * ((abs(match) + abs(other)) * (int(wide.max()) + 1)), wide)
            highest = np.maximum(np.maximum.accumulate(line + apart) - apart, 0)
            out[a:b][full] = np.minimum(np.minimum.reduceat(line - highest, base), 0)
        a = b
    return out
