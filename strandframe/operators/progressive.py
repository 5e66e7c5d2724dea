"""Multiple alignment by rounds of profile alignment, for all alignments at once.

Members are merged two groups at a time in guide order.  A set of up to ``ALONE``
characters is aligned, refined or updated in one call of a kernel (``jvm``), a
shuffle for all.  Larger ones take ``log2(members)`` jobs, in which a call sees two
profiles (sites x letters), never the members, and members take their new gaps by
a join with the column map.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe import jvm as J
from strandframe.functions import runs as U
from strandframe.operators.pairwise import Scorer, align, balanced, letter_matrix
from strandframe.session import cut_lineage


COLS = ("many", "width", "p", "c", "n")
#: Characters of an alignment that one task works on by itself; larger ones take jobs of their own.
ALONE = 4_000_000
#: Cells of a task of the kernels: what some seconds score.
TASK_CELLS = 1_000_000_000


def by_size(rows: DataFrame, cost, alone: int) -> tuple[DataFrame | None, float, DataFrame]:
    """Sets of more than ``alone`` characters (None if there are none), the others' sum of ``cost(cells, width)``, and the others."""
    size = cut_lineage(rows.groupBy("msa_id").agg(F.coalesce(F.sum(F.length("a")), F.lit(0)).alias("cells"), F.coalesce(F.max(F.length("a")), F.lit(0)).alias("width")))
    huge = size.filter(F.col("cells") > alone).select("msa_id")
    own = F.when(F.col("cells") <= alone, cost(F.col("cells").cast("double"), F.col("width")))
    some, total = size.agg(F.max("cells") > alone, F.sum(own)).first()
    if not some:
        return None, total or 0.0, rows
    return rows.join(huge, "msa_id", "left_semi"), total or 0.0, rows.join(huge, "msa_id", "left_anti")


def group_profiles(rows: DataFrame) -> DataFrame:
    """``(msa_id, g, many, width, p, c, n)``: sparse letter counts per site of every group."""
    cells = rows.select("msa_id", "g", F.posexplode(F.split("a", "")).alias("p", "r")).filter("r != '-' AND r != ''")
    counts = cells.groupBy("msa_id", "g", "p", "r").agg(F.count("*").cast("int").alias("n"))
    prof = counts.groupBy("msa_id", "g").agg(F.collect_list(F.struct("p", (F.ascii("r") - 65).alias("c"), "n")).alias("x"))
    prof = prof.select("msa_id", "g", F.col("x.p").alias("p"), F.col("x.c").alias("c"), F.col("x.n").alias("n"))
    size = rows.groupBy("msa_id", "g").agg(F.count("*").alias("many"), F.max(F.length("a")).alias("width"))
    return size.join(prof, ["msa_id", "g"], "left")


def dense(p, c, n, width: int) -> np.ndarray:
    out = np.zeros((width, 26))
    if p is not None:
        out[p, c] = n
    return out


def profile_scorer(wa: np.ndarray, wb: np.ndarray, na: int, nb: int, matrix, v, u, mode="global") -> Scorer:
    """Mean score of the cross pairs of two columns; gap costs stay per alignment."""
    left, right = wa @ matrix / na, wb.T / nb
    return Scorer(lambda i: left[i] @ right, len(wa), len(wb), v, u, mode)


def column_map(runs) -> tuple[list[int], list[int]]:
    """Source site (1-based, 0 for a new gap) of every merged column on both sides."""
    a, b, i, j = [], [], 0, 0
    for op, n in runs:
        a += list(range(i + 1, i + n + 1)) if op != "I" else [0] * n
        b += list(range(j + 1, j + n + 1)) if op != "D" else [0] * n
        i += n if op != "I" else 0
        j += n if op != "D" else 0
    return a, b


def _merge_round(rows: DataFrame, matrix, v: float, u: float) -> DataFrame:
    prof = group_profiles(rows).withColumn("k", F.floor(F.col("g") / 2))
    left = prof.filter("g % 2 = 0").select("msa_id", "k", *[F.col(c).alias(f"{c}1") for c in COLS])
    right = prof.filter("g % 2 = 1").select("msa_id", "k", *[F.col(c).alias(f"{c}2") for c in COLS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows_out = []
            for t in pdf.itertuples(index=False):
                wa, wb = dense(t.p1, t.c1, t.n1, t.width1), dense(t.p2, t.c2, t.n2, t.width2)
                _, runs, _, _ = align(profile_scorer(wa, wb, t.many1, t.many2, matrix, v, u))
                a, b = column_map(runs)
                rows_out += [(t.msa_id, 2 * t.k, a), (t.msa_id, 2 * t.k + 1, b)]
            yield pd.DataFrame(rows_out, columns=["msa_id", "g", "src"])

    maps = balanced(left.join(right, ["msa_id", "k"]), F.col("width1"), F.col("width2")).mapInPandas(run, "msa_id long, g long, src array<int>")
    return apply_columns(rows, maps, ["msa_id", "g"]).withColumn("g", F.floor(F.col("g") / 2))


def apply_columns(rows: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    """New rows from a column map per key; rows without a map keep their columns."""
    chars = rows.withColumn("chars", F.split("a", "")).join(maps, keys, "left")
    new = F.array_join(F.transform("src", lambda i: F.when(i == 0, "-").otherwise(F.element_at("chars", F.greatest(i, F.lit(1))))), "")
    return chars.withColumn("a", F.when(F.col("src").isNull(), F.col("a")).otherwise(new)).drop("chars", "src")


def progressive(members: DataFrame, matrix=None, v: float = 9, u: float = 2, alone: int = ALONE) -> DataFrame:
    """Align ``(msa_id, member, g, a)``: ``g`` is the place in the guide order, 0, 1, 2 ...

    Neighbouring groups merge in every round, which is the balanced tree over
    the order (the leaf order of a clustering tree, or catalogue order).  Rows without
    a set, a place or a text pass untouched.
    """
    m = letter_matrix() if matrix is None else matrix
    given = members.select("msa_id", "member", F.col("g").cast("long").alias("g"), "a")
    placed_ = F.coalesce(F.expr("msa_id IS NOT NULL AND a IS NOT NULL AND g >= 0"), F.lit(False))
    huge, cost, small = by_size(given.filter(placed_), lambda cells, width: cells * width, alone)
    sets = J.dealt(small, cost, TASK_CELLS).groupBy("msa_id").agg(F.collect_list(F.struct("g", "member", "a")).alias("x"))
    new = J.kernel(given.sparkSession, "Progressive", F.col("x.g"), F.col("x.a"), J.costs(m, v, u))
    done = sets.select("msa_id", F.inline(F.arrays_zip(F.col("x.member").alias("member"), new.alias("a"))))
    done = done.select("msa_id", "member", "a").unionByName(given.filter(~placed_).select("msa_id", "member", "a"))
    if huge is None:
        return done
    rows = cut_lineage(huge)
    while not rows.filter("g > 0").isEmpty():
        rows = cut_lineage(_merge_round(rows, m, v, u))
    return done.unionByName(rows.select("msa_id", "member", "a"))


class GapStates:
    """Counts of gap states per site: gaps by how many came right before, residues by the run of gaps before them."""

    STEP = 1 << 32

    def __init__(self, p, k, n):
        key = np.asarray(p, np.int64) * self.STEP + np.asarray(k, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.sum = key[order], np.concatenate([[0], np.cumsum(np.asarray(n, np.int64)[order])])

    def below(self, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Number at sites ``p`` with a state below ``k``."""
        at = lambda x: self.sum[np.searchsorted(self.key, x)]
        return at(p * self.STEP + np.maximum(k, 0)) - at(p * self.STEP)

    def at(self, p: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.below(p, k + 1) - self.below(p, k)


def states_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gaps (True) of a row, and at every site the number of gaps right before it."""
    gap = own < 0
    site = np.arange(len(own))
    last = np.maximum.accumulate(np.where(gap, -1, site)) if len(own) else site
    return gap, site - 1 - np.concatenate([[-1], last[:-1]]) if len(own) else site


class Rest:
    """An alignment without one of its members: letters per column that is not empty, and gap states there."""

    def __init__(self, profile: np.ndarray, many: int, gaps: tuple, late: tuple, own: np.ndarray):
        gap, before = states_of(own)
        at = np.flatnonzero(~gap)
        profile = profile.copy()
        profile[at, own[at]] -= 1
        self.many = many - 1
        self.cols = np.flatnonzero(profile.sum(1) > 0)
        self.profile = profile[self.cols]
        self.res = self.profile.sum(1).astype(np.int64)
        # the member's own states go; what is left is counted in the columns that stay
        mine = np.flatnonzero(gap)
        g = [np.concatenate([np.asarray(x, np.int64), y]) for x, y in zip(gaps, (mine, before[mine], np.full(len(mine), -1)))]
        late_own = at[before[at] > 0]
        r = [np.concatenate([np.asarray(x, np.int64), y]) for x, y in zip(late, (late_own, before[late_own], np.full(len(late_own), -1)))]
        kept = np.zeros(len(profile) + 1, np.int64)
        kept[self.cols + 1] = 1
        count = np.cumsum(kept)  # columns that stay before each site
        stays = np.zeros(len(profile), bool)
        stays[self.cols] = True

        def moved(p, k, n):
            ok = stays[p]
            p, k, n = p[ok], k[ok], n[ok]
            return count[p], count[p] - count[p - k], n

        self.gaps = GapStates(*moved(*g))
        p, k, n = moved(*r)
        late_n = np.bincount(p, n, len(self.cols)).astype(np.int64) if len(p) else np.zeros(len(self.cols), np.int64)
        self.residues = GapStates(np.concatenate([p, np.arange(len(self.cols))]), np.concatenate([k, np.zeros(len(self.cols), np.int64)]), np.concatenate([n, self.res - late_n]))

    def score(self, ops: np.ndarray, sim: np.ndarray, v: float, u: float) -> float:
        """Sum of the member's pair scores, openings counted per pair, along steps ``M`` (0), ``D`` (1, the member has a gap) and ``I`` (2)."""
        if not len(ops):
            return 0.0
        step = np.arange(len(ops))
        free = ops != 1
        last = np.concatenate([[-1], np.maximum.accumulate(np.where(free, step, -1))[:-1]])
        run = step - 1 - last  # gaps of the member right before
        fresh = (last < 0) | (ops[last] == 0)  # the letter before them stands in a column of the rest
        c = np.cumsum(ops != 2) - (ops != 2)  # column of the rest, here or next
        j = np.cumsum(ops != 1) - (ops != 1)
        m, d, i = (np.flatnonzero(ops == k) for k in (0, 1, 2))
        total = sim[c[m], j[m]].sum() - u * (self.res[c[d]].sum() + (self.many - self.res[c[m]]).sum() + len(i) * self.many)
        opened = (self.res[c[d]] - self.residues.below(c[d], run[d])).sum()
        opened += (self.gaps.below(c[m], run[m]) + fresh[m] * self.gaps.at(c[m], run[m])).sum()
        none = np.where(c[i] > 0, self.res[np.maximum(c[i] - 1, 0)] if len(self.res) else 0, self.many)
        before = c[i] - 1
        inside = np.where(before >= 0, self.gaps.below(np.maximum(before, 0), run[i] - 1), 0)
        exact = np.where(run[i] == 0, none, np.where(before >= 0, self.gaps.at(np.maximum(before, 0), run[i] - 1), 0))
        opened += ((run[i] > 0) * none + inside + fresh[i] * exact).sum()
        return float(total - v * opened)


def group_states(rows: DataFrame) -> DataFrame:
    """``(msa_id, gp, gk, gn, rp, rk, rn)``: gap states of all members, counted per site (from 0) and run length."""
    runs = rows.select("msa_id", F.length("a").alias("width"), F.inline(U.runs("a", U.GAP)))
    gaps = runs.select("msa_id", "l", F.explode(F.sequence(F.lit(0), F.col("r") - F.col("l") - 1)).alias("k")).groupBy("msa_id", (F.col("l") + F.col("k")).alias("p"), "k").agg(F.count("*").alias("n"))
    late = runs.filter("r < width").groupBy("msa_id", F.col("r").alias("p"), (F.col("r") - F.col("l")).alias("k")).agg(F.count("*").alias("n"))

    def lists(d: DataFrame, mark: str) -> DataFrame:
        g = d.groupBy("msa_id").agg(F.collect_list(F.struct("p", "k", "n")).alias("x"))
        return g.select("msa_id", *[F.col(f"x.{c}").alias(f"{mark}{c}") for c in "pkn"])

    return lists(gaps, "g").join(lists(late, "r"), "msa_id", "full")


def best_moves(rows: DataFrame, matrix=None, v: float = 9, u: float = 2, alone: int = ALONE) -> DataFrame:
    """The move of each alignment that gains most: ``(msa_id, member, gain, rest, own)``, two column maps; none if no move gains.

    Every member is realigned against the others.  What a move gains is the
    change of the whole alignment's sum of pair scores, openings counted for every
    pair (pairs of the others don't change); ties go to the smaller member.
    """
    m = letter_matrix() if matrix is None else matrix
    huge, cost, small = by_size(rows.filter("msa_id IS NOT NULL AND a IS NOT NULL"), lambda cells, width: cells * width, alone)
    sets = J.dealt(small, cost, TASK_CELLS).groupBy("msa_id").agg(F.array_sort(F.collect_list(F.struct("member", "a"))).alias("x"))
    best = sets.select("msa_id", "x.member", J.kernel(rows.sparkSession, "BestMove", F.col("x.a"), J.costs(m, v, u)).alias("b")).filter("b IS NOT NULL")
    part = lambda at: F.expr(f"transform(slice(b, {at}, cast(b[2] as int)), x -> cast(x as int))")
    best = best.select("msa_id", F.expr("member[cast(b[0] as int)]").alias("member"), F.expr("b[1]").alias("gain"), part("4").alias("rest"), part("4 + cast(b[2] as int)").alias("own"))
    return best if huge is None else best.unionByName(_best_moves(huge, m, v, u))


def _best_moves(rows: DataFrame, m, v: float, u: float) -> DataFrame:
    """``best_moves`` with a kernel call for each member: the letters and gap states of all, less the member's."""
    prof = group_profiles(rows.withColumn("g", F.lit(0))).filter("many > 1").select("msa_id", *COLS)
    prof = cut_lineage(prof.join(group_states(rows), "msa_id", "left"))
    calls = rows.select("msa_id", "member", F.col("a").alias("row")).join(prof, "msa_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                gaps, late = (tuple(np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in y) for y in ((t.gp, t.gk, t.gn), (t.rp, t.rk, t.rn)))
                better = realign(dense(t.p, t.c, t.n, t.width), t.many, gaps, late, letters_of(t.row), m, v, u)
                if better is not None:
                    out.append((t.msa_id, t.member, *better))
            yield pd.DataFrame(out, columns=["msa_id", "member", "gain", "rest", "own"])

    moves = balanced(calls, F.col("width"), F.length("row")).mapInPandas(run, "msa_id long, member long, gain double, rest array<int>, own array<int>")
    best = moves.groupBy("msa_id").agg(F.max(F.struct("gain", (-F.col("member")).alias("k"), "rest", "own")).alias("x"))
    return best.select("msa_id", (-F.col("x.k")).alias("member"), "x.gain", "x.rest", "x.own")


def refine(rows: DataFrame, matrix=None, v: float = 9, u: float = 2, alone: int = ALONE) -> DataFrame:
    """Iterative refinement ``(msa_id, member, a)``: the best move of every alignment, until no move of it gains.

    Every move raises the sum of pair scores with gap openings, which is bounded, so
    the loop ends.  Alignments of up to ``alone`` characters are refined in one task
    each, by the same moves; in larger ones a job realigns all members at once, and
    no task holds more than the profile and one member.
    """
    m = letter_matrix() if matrix is None else matrix
    full = cut_lineage(rows.select("msa_id", "member", "a").filter("msa_id IS NOT NULL"))
    huge, cost, small = by_size(full, lambda cells, width: cells * width * 8, alone)
    sets = J.dealt(small, cost, TASK_CELLS).groupBy("msa_id").agg(F.array_sort(F.collect_list(F.struct("member", "a"))).alias("x"))
    new = J.kernel(rows.sparkSession, "Refined", F.col("x.a"), J.costs(m, v, u))
    done = sets.select("msa_id", F.inline(F.arrays_zip(F.col("x.member").alias("member"), new.alias("a")))).select("msa_id", "member", "a")
    if huge is None:
        return done
    done = done.unionByName(huge.filter("a IS NULL"))
    width = huge.groupBy("msa_id").agg(F.max(F.length("a")).alias("width"))
    active = cut_lineage(huge.filter("a IS NOT NULL").join(width, "msa_id").select("msa_id", "member", F.expr("rpad(a, width, '-')").alias("a")))
    while not active.isEmpty():
        moves = cut_lineage(_best_moves(active, m, v, u))
        done = done.unionByName(active.join(moves.select("msa_id"), "msa_id", "left_anti"))
        met = active.join(moves.drop("gain").withColumnRenamed("member", "mover"), "msa_id")
        maps = met.withColumn("src", F.when(F.col("member") == F.col("mover"), F.col("own")).otherwise(F.col("rest")))
        active = cut_lineage(moved(maps).select("msa_id", "member", "a"))
    return done


def letters_of(row: str) -> np.ndarray:
    """Letters as numbers from 0, gaps negative."""
    return np.frombuffer(row.encode(), np.uint8).astype(np.int64) - 65


def moved(rows: DataFrame) -> DataFrame:
    """Rows with their column map ``src`` applied to ``a``."""
    chars = rows.withColumn("chars", F.split("a", ""))
    new = F.array_join(F.transform("src", lambda i: F.when((i == 0) | (i > F.length("a")), "-").otherwise(F.element_at("chars", F.greatest(i, F.lit(1))))), "")
    return chars.withColumn("a", new).drop("chars", "src")


def realign(profile: np.ndarray, many: int, gaps: tuple, late: tuple, own: np.ndarray, matrix, v, u):
    """``(gain, map of the rest, map of the row)`` of a better placement of the member ``own``, or None; the first three describe all members."""
    rest = Rest(profile, many, gaps, late, own)
    sites = np.flatnonzero(own >= 0)
    if not len(rest.cols) or not len(sites):
        return None
    wb = np.zeros((len(sites), 26))
    wb[np.arange(len(sites)), own[sites]] = 1
    _, runs, _, _ = align(profile_scorer(rest.profile, wb, rest.many, 1, matrix, v, u))
    sim = rest.profile @ matrix[:, own[sites]]
    filled = np.zeros(len(own), bool)
    filled[rest.cols] = True
    present = np.where(filled & (own >= 0), 0, np.where(filled, 1, 2))[filled | (own >= 0)]
    new = np.repeat(["MDI".index(op) for op, _ in runs], [n for _, n in runs])
    gain = rest.score(new, sim, v, u) - rest.score(present, sim, v, u)
    if gain <= 1e-9:
        return None
    a, b = column_map(runs)
    return gain, [int(rest.cols[x - 1]) + 1 if x else 0 for x in a], [int(sites[x - 1]) + 1 if x else 0 for x in b]


def placed(profile: np.ndarray, many: int, own: np.ndarray, matrix, v, u) -> tuple[list[int], list[int]]:
    """Maps of the columns of a group (empty ones left out) and of a sequence aligned to it."""
    cols = np.flatnonzero(profile.sum(1) > 0)
    wb = np.zeros((len(own), 26))
    wb[np.arange(len(own)), own] = 1
    if not len(cols) or not len(own):
        return [0] * len(own) + [int(c) + 1 for c in cols], list(range(1, len(own) + 1)) + [0] * len(cols)
    _, runs, _, _ = align(profile_scorer(profile[cols], wb, many, 1, matrix, v, u))
    a, b = column_map(runs)
    return [int(cols[x - 1]) + 1 if x else 0 for x in a], b


def update_members(rows: DataFrame, guests: DataFrame, matrix=None, v: float = 9, u: float = 2, alone: int = ALONE) -> DataFrame:
    """Alignments ``(msa_id, member, a)`` with ``guests (msa_id, member, s)`` put in: a member of that name gives way, others are added.

    A guest is aligned to the profile of the members that stay, whose empty columns
    go.  Guests of one alignment come in one after the other, in order of their names;
    alignments without guests pass untouched.  The rest's columns keep their order, so
    members that stay keep their places towards each other.  Alignments of more than
    ``alone`` characters, their guests' included, take a round of jobs for each guest.
    """
    m = letter_matrix() if matrix is None else matrix
    long_ = lambda d: d.select("msa_id", F.col("member").cast("long").alias("member"), "a")
    own = long_(rows).withColumn("guest", F.lit(False))
    new = long_(guests.withColumn("a", F.coalesce("s", F.lit("")))).withColumn("guest", F.lit(True))
    both = own.unionByName(new).filter("msa_id IS NOT NULL")
    loose = long_(rows).filter("msa_id IS NULL").unionByName(long_(guests.withColumn("a", F.coalesce("s", F.lit("")))).filter("msa_id IS NULL"))
    huge, cost, small = by_size(both, lambda cells, width: cells * width, alone)
    sets = J.dealt(small, cost, TASK_CELLS).groupBy("msa_id").agg(F.array_sort(F.collect_list(F.struct("guest", "member", "a"))).alias("x"))
    side = lambda q: F.expr(f"filter(x, y -> {q}y.guest)")
    sets = sets.select("msa_id", side("NOT ").alias("rows"), side("").alias("guests"))
    found = J.kernel(rows.sparkSession, "Updated", F.col("rows.member"), F.col("rows.a"), F.col("guests.member"), F.col("guests.a"), J.costs(m, v, u))
    done = sets.select("msa_id", F.inline(found)).unionByName(loose)
    if huge is None:
        return done
    huge = cut_lineage(huge)
    return done.unionByName(_update_members(huge.filter("NOT guest").drop("guest"), huge.filter("guest").select("msa_id", "member", F.col("a").alias("s")), m, v, u))


def _update_members(rows: DataFrame, guests: DataFrame, m, v: float, u: float) -> DataFrame:
    """``update_members`` with a round of jobs for each guest."""
    turn = F.row_number().over(W.partitionBy("msa_id").orderBy("member"))
    guests = cut_lineage(guests.select("msa_id", "member", F.coalesce("s", F.lit("")).alias("s")).withColumn("turn", turn))
    named = guests.select("msa_id").distinct()
    out = rows.select("msa_id", "member", "a").join(named, "msa_id", "left_anti")
    active = cut_lineage(rows.select("msa_id", "member", "a").join(named, "msa_id"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for t in pdf.itertuples(index=False):
                wide = 0 if pd.isna(t.width) else int(t.width)
                profile = dense(t.p, t.c, t.n, wide) if wide else np.zeros((0, 26))
                done.append((t.msa_id, t.member, t.s, *placed(profile, max(1, 0 if pd.isna(t.many) else int(t.many)), letters_of(t.s), m, v, u)))
            yield pd.DataFrame(done, columns=["msa_id", "member", "s", "rest", "own"])

    k = 0
    while not (now := guests.filter(F.col("turn") == k + 1)).isEmpty():
        k += 1
        rest = active.join(now.select("msa_id", "member"), ["msa_id", "member"], "left_anti")
        prof = group_profiles(rest.withColumn("g", F.lit(0))).select("msa_id", *COLS)
        calls = now.join(prof, "msa_id", "left")
        maps = cut_lineage(balanced(calls, F.coalesce("width", F.lit(0)), F.length("s")).mapInPandas(run, "msa_id long, member long, s string, rest array<int>, own array<int>"))
        others = rest.join(maps.select("msa_id", F.col("rest").alias("src")), "msa_id", "left").withColumn("src", F.coalesce("src", F.expr("transform(sequence(1, greatest(length(a), 1)), i -> i)")))
        guest = maps.select("msa_id", "member", F.col("s").alias("a"), F.col("own").alias("src"))
        active = cut_lineage(moved(others.unionByName(guest)).select("msa_id", "member", "a"))
    return out.unionByName(active)
