"""Chains of matches with charged overlap, and alignments that are cut at their chain.

A chain's score is its matched letters, less ``open + extend * shift`` for a change
of diagonal and one a letter for an overlap, which may be up to half of the shorter
match.  Scores are kept in tenths, so equal chains are equal.

Of two matches without overlap the later one's constraint is one-sided: where its
diagonal is not below the earlier one's, the ends in the query decide, else those in
the entry.  So the best predecessor is a range maximum over diagonals among matches
that end in time.  Divide and conquer over the order of starts turns that into
sweeps with a prefix-maximum tree, n log^2 n steps for n matches; overlapping
predecessors start within the longest match's length and are looked at one by one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.operators.pairwise import letter_matrix, pair_alignments
from strandframe.session import cut_lineage

NONE = (-(2**62), 0)


class PrefixMax:
    """Largest ``(value, -index)`` among places up to a bound."""

    def __init__(self, n: int):
        self.best = [NONE] * (n + 1)

    def put(self, place: int, item: tuple[int, int]) -> None:
        place += 1
        while place < len(self.best):
            if item > self.best[place]:
                self.best[place] = item
            place += place & -place

    def get(self, count: int) -> tuple[int, int]:
        """Of the first ``count`` places."""
        out = NONE
        while count:
            out = max(out, self.best[count])
            count -= count & -count
        return out


def best_chain(qs: list[int], ds: list[int], ln: list[int], open_: int = 30, extend: int = 1) -> tuple[int, list[int]]:
    """Score in tenths and the places of the best chain; matches must be sorted by query, entry, length."""
    n = len(qs)
    qe, de, diag = [a + k for a, k in zip(qs, ln)], [a + k for a, k in zip(ds, ln)], [b - a for a, b in zip(qs, ds)]
    score, gain, back = [0] * n, [(0, 1)] * n, [-1] * n
    by_d = sorted(range(n), key=lambda i: (ds[i], i))
    starts_d, longest = [ds[i] for i in by_d], max(ln, default=0)

    def offer(i: int, value: int, j: int) -> None:
        if value > 0 and (value, -j) > gain[i]:
            gain[i] = (value, -j)

    def settle(i: int) -> None:
        near = set(by_d[bisect_left(starts_d, ds[i] - longest + 1) : bisect_left(starts_d, ds[i])])
        j = i - 1
        while j >= 0 and qs[j] > qs[i] - longest:
            near.add(j)
            j -= 1
        for j in near:
            over = max(qe[j] - qs[i], de[j] - ds[i])
            if over > 0 and j < i and 2 * over <= min(ln[i], ln[j]) and qs[j] < qs[i] and ds[j] < ds[i] and qe[j] < qe[i] and de[j] < de[i]:
                shift = abs(diag[i] - diag[j])
                offer(i, score[j] - 10 * over - (open_ + extend * shift if shift else 0), j)
        score[i] = 10 * ln[i] + max(gain[i][0], 0)
        back[i] = -gain[i][1] if gain[i][0] > 0 else -1

    def cross(left: range, right: range) -> None:
        ranks = {d: k for k, d in enumerate(sorted({diag[j] for j in left}))}
        places = sorted(ranks)
        for ends, begins, sign in ((qe, qs, 1), (de, ds, -1)):
            tree, same = PrefixMax(len(ranks)), {}
            todo = sorted(left, key=lambda j: ends[j])
            k = 0
            for i in sorted(right, key=lambda i: begins[i]):
                while k < len(todo) and ends[todo[k]] <= begins[i]:
                    j = todo[k]
                    place = ranks[diag[j]] if sign > 0 else len(ranks) - 1 - ranks[diag[j]]
                    tree.put(place, (score[j] + sign * extend * diag[j], -j))
                    same[diag[j]] = max(same.get(diag[j], NONE), (score[j], -j))
                    k += 1
                if sign > 0 and diag[i] in same:
                    offer(i, same[diag[i]][0], -same[diag[i]][1])
                count = bisect_left(places, diag[i])
                if sign < 0:
                    count = len(places) - count - (diag[i] in ranks)
                value, j = tree.get(count)
                if value > NONE[0]:
                    offer(i, value - sign * extend * diag[i] - open_, -j)

    def solve(low: int, high: int) -> None:
        if high - low == 1:
            settle(low)
            return
        mid = (low + high) // 2
        solve(low, mid)
        cross(range(low, mid), range(mid, high))
        solve(mid, high)

    if not n:
        return 0, []
    solve(0, n)
    i = max(range(n), key=lambda i: (score[i], -i))
    top, path = score[i], []
    while i >= 0:
        path.append(i)
        i = back[i]
    return top, path[::-1]


def chains(hits: DataFrame, open_: float = 3.0, extend: float = 0.1) -> DataFrame:
    """Members of the best chain of each pair in order: ``(q_id, seq_id, score, k, q_start, d_start, len)``.

    A pair's matches are bounded by its two texts and become one row; a call chains
    many pairs, dealt over at least as many tasks as there are cores.
    """
    a, b = round(open_ * 10), round(extend * 10)
    tasks = max(hits.sparkSession.sparkContext.defaultParallelism, int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    match = F.struct("q_start", "d_start", "len")
    pairs = hits.repartition(tasks, "q_id", "seq_id").groupBy("q_id", "seq_id").agg(F.array_sort(F.collect_list(match)).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            offs, flat = lists.offsets.to_numpy(), lists.values
            qs, ds, ln = (flat.field(c).to_pylist() for c in ("q_start", "d_start", "len"))
            at, score, k, pair = [], [], [], []
            for i, (low, high) in enumerate(zip(offs, offs[1:])):
                top, path = best_chain(qs[low:high], ds[low:high], ln[low:high], a, b)
                at += [low + j for j in path]
                score += [top / 10] * len(path)
                k += range(1, len(path) + 1)
                pair += [i] * len(path)
            names = ["q_id", "seq_id", "score", "k", "q_start", "d_start", "len"]
            ids = [batch.column(c).take(pa.array(pair, pa.int64())) for c in names[:2]]
            cols = [flat.field(c).take(pa.array(at, pa.int64())) for c in names[4:]]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(score, pa.float64()), pa.array(k, pa.int64()), *cols], names)

    return pairs.mapInArrow(run, "q_id long, seq_id long, score double, k long, q_start long, d_start long, len long")


def seeded_alignments(members: DataFrame, queries: DataFrame, seqs: DataFrame, v: float = 9, u: float = 2, matrix=None) -> DataFrame:
    """Alignment of each pair from the first to the last match of its chain: ``(q_id, seq_id, q_l, q_r, d_l, d_r, s1, s2, score, cigar)``.

    The texts are searched once for the stretches ``s1`` and ``s2`` of the chains.
    What lies between two matches is aligned as a pair of its own, so that a long pair
    is dealt over tasks; an overlap is taken from the later match.  Steps and scores
    are put together by position.
    """
    m = letter_matrix() if matrix is None else matrix
    w = W.partitionBy("q_id", "seq_id").orderBy("k")  # one pair's chain
    q_end, d_end = F.col("q_start") + F.col("len"), F.col("d_start") + F.col("len")
    d = members.withColumn("q_p", F.lag(q_end).over(w)).withColumn("d_p", F.lag(d_end).over(w))
    over = F.greatest(F.lit(0), F.coalesce(F.col("q_p") - F.col("q_start"), F.lit(0)), F.coalesce(F.col("d_p") - F.col("d_start"), F.lit(0)))
    d = d.withColumn("over", over).select(
        "q_id", "seq_id", "k", (F.col("q_start") + F.col("over")).alias("q_start"), (F.col("d_start") + F.col("over")).alias("d_start"), (F.col("len") - F.col("over")).alias("len"), "q_p", "d_p")
    cut = lambda s, a, b, of: F.substring(s, (F.col(a) - F.col(of) + 1).cast("int"), (F.col(b) - F.col(a)).cast("int"))
    hull = members.groupBy("q_id", "seq_id").agg(F.min("q_start").alias("q_l"), F.max(q_end - 1).alias("q_r"), F.min("d_start").alias("d_l"), F.max(d_end - 1).alias("d_r"))
    whole = hull.join(queries.select("q_id", F.col("s").alias("x")), "q_id").join(seqs.select("seq_id", F.col("s").alias("y")), "seq_id")
    part = lambda s, l, r: F.substring(s, F.col(l).cast("int"), (F.col(r) - F.col(l) + 1).cast("int"))
    hull = cut_lineage(whole.select(*hull.columns, part("x", "q_l", "q_r").alias("s1"), part("y", "d_l", "d_r").alias("s2")))
    gap = d.filter("q_p IS NOT NULL AND (q_p < q_start OR d_p < d_start)").join(hull, ["q_id", "seq_id"])
    pairs = gap.select("q_id", "seq_id", "k", cut("s1", "q_p", "q_start", "q_l").alias("s1"), cut("s2", "d_p", "d_start", "d_l").alias("s2"))
    between = pair_alignments(pairs, "q_id long, seq_id long, k long", v, u, "global", m).select("q_id", "seq_id", "k", F.lit(0).alias("o"), "score", "cigar")
    # matches are equal letters: their own scores
    value = F.create_map(*[z for i in range(26) for z in (F.lit(chr(65 + i)), F.lit(float(m[i, i])))])
    own = d.join(hull, ["q_id", "seq_id"]).select("q_id", "seq_id", "k", F.lit(1).alias("o"), F.aggregate(
        F.split(F.expr("substring(s1, cast(q_start - q_l + 1 as int), cast(len as int))"), ""), F.lit(0.0), lambda a, c: a + F.coalesce(value[c], F.lit(0.0))).alias("score"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"))
    steps = between.unionByName(own).groupBy("q_id", "seq_id").agg(F.sum("score").alias("score"), F.array_sort(F.collect_list(F.struct("k", "o", "cigar"))).alias("c"))
    return hull.join(steps.select("q_id", "seq_id", "score", F.array_join("c.cigar", "").alias("cigar")), ["q_id", "seq_id"])
