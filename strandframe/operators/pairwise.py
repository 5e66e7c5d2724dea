"""Pairwise alignment of many pairs: affine dynamic programming inside Arrow batches.

Spark enumerates and spreads the pairs; one small row-vectorized kernel scores
them.  For large pairs the traceback keeps every ``stride``-th row and
recomputes one block at a time, so memory grows with ``sqrt(m) * n`` and whole sequences are aligned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import groupby
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandframe.functions.residues import LETTERS, REDUCED

NEG = -1e18
#: Cells of one kernel task: what a few seconds of row steps score.
TASK_CELLS = 200_000_000
#: Cells of a pair whose choices are all kept, so that none is worked out twice.
FULL = 2_000_000


def letter_matrix(match: float = 4, similar: float = 1, mismatch: float = -1, classes: str = "LLQZ1.6") -> np.ndarray:
    """26 x 26 substitution scores from a rule: identity, same reduced class, other."""
    m = np.full((26, 26), float(mismatch))
    for cls in REDUCED[classes].split("|"):
        idx = [LETTERS.index(c) for c in cls]
        m[np.ix_(idx, idx)] = similar
    np.fill_diagonal(m, match)
    return m


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode(), np.uint8).astype(np.int64) - 65


class Scorer:
    """Row similarities of two inputs and their gap costs.

    ``row(i)`` gives the similarities of row i with every column; ``v`` opens
    and ``u`` extends a gap.
    """

    def __init__(self, row: Callable[[int], np.ndarray], m: int, n: int, v: float, u: float, mode: str):
        self.row, self.m, self.n, self.v, self.u, self.mode = row, m, n, v, u, mode
        self.steps = u * np.arange(n + 1)

    def first(self):
        h = np.zeros(self.n + 1) if self.mode != "global" else np.concatenate([[0.0], -self.v - self.steps[1:]])
        return h, np.full(self.n + 1, NEG)

    def next(self, i: int, h: np.ndarray, e: np.ndarray, trace: bool = False):
        """Advance one row; optionally return the choices of every cell."""
        opened = h - self.v
        e_new = np.maximum(e, opened) - self.u
        g = np.empty(self.n + 1)
        g[1:] = h[:-1] + self.row(i)
        g[0] = e_new[0] if self.mode == "global" else 0.0
        diag = g.copy()
        np.maximum(g, e_new, out=g)
        if self.mode == "local":
            np.maximum(g, 0.0, out=g)
        run = np.maximum.accumulate(g + self.steps)
        f = np.full(self.n + 1, NEG)
        f[1:] = run[:-1] - self.v - self.steps[1:]
        out = np.maximum(g, f)
        if not trace:
            return out, e_new, None
        pick = np.where(f > g, 2, np.where(e_new > diag, 1, 0)).astype(np.uint8)
        if self.mode == "local":
            pick[(out <= 0)] = 3
        longer = np.zeros(self.n + 1, bool)  # the horizontal gap comes from further left
        longer[1:] = f[1:] == f[:-1] - self.u
        return out, e_new, (pick, e > opened, longer)


def score_only(s: Scorer) -> float:
    h, e = s.first()
    best = h.max() if s.mode == "local" else h[-1]
    edge = h[-1]
    for i in range(s.m):
        h, e, _ = s.next(i, h, e)
        if s.mode == "local":
            best = max(best, h.max())
        edge = max(edge, h[-1])
    if s.mode == "global":
        return float(h[-1])
    return float(best) if s.mode == "local" else float(max(edge, h.max()))


def align(s: Scorer, full: int = FULL) -> tuple[float, list[tuple[str, int]], int, int]:
    """Score, run-length path (M both, D row only, I column only) and start offsets.

    Pairs of up to ``full`` cells keep all choices of the first pass; others keep
    every ``sqrt(m)``-th row and work out one block at a time.  The path is the same.
    """
    keep = s.m * s.n <= full
    stride = max(isqrt(s.m), 1)
    h, e = s.first()
    saved, block = {0: (h, e)}, {}
    best, bi, bj = (h[-1], 0, s.n) if s.mode == "semiglobal" else (0.0, 0, 0)
    for i in range(s.m):
        h, e, choices = s.next(i, h, e, keep)
        if keep:
            block[i + 1] = choices
        elif (i + 1) % stride == 0:
            saved[i + 1] = (h, e)
        if s.mode == "local" and h.max() > best:
            best, bi, bj = h.max(), i + 1, int(h.argmax())
        elif s.mode == "semiglobal" and h[-1] > best:
            best, bi, bj = h[-1], i + 1, s.n
    if s.mode == "global":
        best, bi, bj = h[-1], s.m, s.n
    elif s.mode == "semiglobal" and h.max() > best:
        best, bi, bj = h.max(), s.m, int(h.argmax())

    def row(i: int):
        nonlocal block
        if i not in block:
            base = (i - 1) // stride * stride
            hh, ee = saved[base]
            block = {}
            for r in range(base, i):
                hh, ee, block[r + 1] = s.next(r, hh, ee, True)
        return block[i]

    return float(best), *traced(bi, bj, s.mode, row)


def traced(i: int, j: int, mode: str, row: Callable[[int], tuple]) -> tuple[list[tuple[str, int]], int, int]:
    """Run-length path that ends at ``(i, j)`` and its start offsets; ``row(i)`` has the moves, and whether gaps go on, of the cells of a row."""
    ops: list[str] = []
    state, at = 0, -1
    while i > 0 or j > 0:
        if i == 0 or j == 0:
            if mode == "global":
                ops.append(("D" * i) if j == 0 else ("I" * j))
                i = j = 0
            break
        if i != at:
            (pick, extend, longer), at = row(i), i
        move = state or pick[j]
        if move == 3:
            break
        if move == 1:
            ops.append("D")
            state = 1 if extend[j] else 0
            i -= 1
        elif move == 2:
            ops.append("I")
            state = 2 if longer[j] else 0
            j -= 1
        else:
            ops.append("M")
            i, j = i - 1, j - 1
    text = "".join(ops)[::-1]
    runs: list[tuple[str, int]] = []
    for op in text:
        if runs and runs[-1][0] == op:
            runs[-1] = (op, runs[-1][1] + 1)
        else:
            runs.append((op, 1))
    return runs, i, j


def sequence_scorer(a: str, b: str, matrix: np.ndarray, v: float, u: float, mode: str) -> Scorer:
    ca, cb = codes(a), codes(b)
    table = matrix[:, cb]
    return Scorer(lambda i: table[ca[i]], len(ca), len(cb), v, u, mode)


#: Cells of a row over all pairs of a group, and choices of a group that are kept for its paths.
ROW_CELLS, KEPT = 16_384, 32_000_000


def groups(pairs: list[tuple[str, str]], kept: int = 0) -> Iterator[np.ndarray]:
    """Places of pairs that are scored together: of similar widths, longest first, up to ``ROW_CELLS`` a row (and ``kept`` cells in all)."""
    m, n = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    group, deep = [], 0
    for i in np.lexsort((m, n)):  # the last one of a group is its widest
        deeper = max(deep, int(m[i]))
        wide = (len(group) + 1) * int(n[i] + 1)
        if group and (wide > ROW_CELLS or kept and wide * deeper > kept):
            yield np.array(sorted(group, key=lambda x: -m[x]))
            group, deeper = [], int(m[i])
        group.append(i)
        deep = deeper
    if group:
        yield np.array(sorted(group, key=lambda x: -m[x]))


def together(pairs: list[tuple[str, str]], matrix: np.ndarray, v: float, u: float, mode: str, trace: bool = False):
    """Best scores of pairs (longest first members first), with ``Scorer``'s steps on all of them at once.

    Rows are padded on the right, where no cell beats those before it and none acts
    on them; pairs whose first member has ended leave the rows.  With ``trace`` also
    the ends of the paths and the choices of all cells (move, 4: gap goes on, 8: gap comes from further left).
    """
    m, n = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    many, wide, every = len(pairs), int(n.max()), np.arange(len(pairs))
    table = np.full((many, len(matrix), wide), NEG)
    first = np.zeros((many, int(m.max())), np.int64)
    for k, (a, b) in enumerate(pairs):
        table[k, :, : n[k]] = matrix[:, codes(b)]
        first[k, : m[k]] = codes(a)
    steps = u * np.arange(wide + 1)
    h, e = np.zeros((many, wide + 1)), np.full((many, wide + 1), NEG)
    if mode == "global":
        h[:, 1:] = -v - steps[1:]
    best = np.where(mode == "global", h[every, n], 0.0)
    bi, bj = np.zeros(many, np.int64), n.copy() if mode != "local" else np.zeros(many, np.int64)
    choices = np.zeros((len(first[0]), many, wide + 1), np.uint8) if trace else None
    inside = np.arange(wide + 1) <= n[:, None]
    for i in range(len(first[0]) + 1):
        if mode == "semiglobal":  # rows that end here
            for k in np.flatnonzero(m[: len(h)] == i):
                last = np.where(inside[k], h[k], NEG)
                if last.max() > best[k]:
                    best[k], bi[k], bj[k] = last.max(), i, last.argmax()
        live = int(np.count_nonzero(m > i))
        if not live:
            break
        h, e = h[:live], e[:live]
        opened = h - v
        if trace:
            goes_on = e > opened
        e = np.maximum(e, opened) - u
        g = np.empty_like(e)
        np.add(h[:, :-1], table[every[:live], first[:live, i]], out=g[:, 1:])
        g[:, 0] = e[:, 0] if mode == "global" else 0.0
        if trace:
            up = e > g
        np.maximum(g, e, out=g)
        if mode == "local":
            np.maximum(g, 0.0, out=g)
        f = g + steps
        np.maximum.accumulate(f, axis=1, out=f)
        f[:, 1:] = f[:, :-1] - v - steps[1:]
        f[:, 0] = NEG
        h = np.maximum(g, f)
        if trace:
            pick = np.where(f > g, 2, up).astype(np.uint8)
            if mode == "local":
                pick[h <= 0] = 3
            pick += goes_on * np.uint8(4)
            pick[:, 1:] += (f[:, 1:] == f[:, :-1] - u) * np.uint8(8)
            choices[i, :live] = pick
        if mode == "global":
            done = np.flatnonzero(m[:live] == i + 1)
            best[done], bi[done] = h[done, n[done]], i + 1
            continue
        now = h.max(axis=1) if mode == "local" else h[every[:live], n[:live]]
        better = np.flatnonzero(now > best[:live])
        best[better], bi[better] = now[better], i + 1
        bj[better] = h[better].argmax(axis=1) if mode == "local" else n[better]
    return (best, bi, bj, choices) if trace else best


#: Letters of second members whose distances to a first member are counted at once.
LANES = 200_000


def letter_codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def distances(first: str, others: list[str]) -> list[int]:
    """Unit-cost edit distances of ``first`` to others, all in one pass over its letters.

    Steps of a column of all others are bits of one number (Myers, Hyyrö): up and down steps,
    with an empty bit after each other's letters that takes the carry.
    """
    parts = [letter_codes(s) for s in others]
    ends = np.cumsum([len(x) + 1 for x in parts])
    line = np.concatenate([y for x in parts for y in (x, [0])]).astype(np.int64) if parts else np.zeros(0, np.int64)
    line[ends - 1] = -1
    bits = lambda x: int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")
    full = line >= 0
    inside, low = bits(full), np.zeros(len(line), bool)
    low[np.concatenate([[0], ends[:-1]])] = True
    low = bits(low & full)
    text = letter_codes(first).tolist()
    same = {c: bits(line == c) for c in set(text)}
    up, down = inside, 0
    for c in text:
        eq = same[c]
        across = ((((eq & up) + up) ^ up) | eq) & inside
        right = down | (inside & ~(across | up))
        left = up & across
        right = (right << 1 | low) & inside
        left = left << 1 & inside
        eq |= down
        up = left | (inside & ~(eq | right))
        down = right & eq
    size = len(line) // 8 + 1
    steps = [np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), bitorder="little")[: len(line)].astype(np.int64) for x in (up, down)]
    total = np.concatenate([[0], np.cumsum(steps[0] - steps[1])])[ends]
    return (len(text) + np.diff(total, prepend=0)).tolist()


def unit_costs(matrix: np.ndarray, v: float, u: float, mode: str) -> bool:
    """Whether a score is ``-u`` times the number of letters changed, left out or put in (whole numbers, so that no order of sums matters)."""
    same = np.eye(len(matrix), dtype=bool)
    return mode == "global" and v == 0 and u > 0 and float(u).is_integer() and bool((matrix[same] == 0).all() and (matrix[~same] == -u).all())


def unit_scores(pairs: list[tuple[str, str]], u: float) -> np.ndarray:
    """Scores of pairs by unit costs; neighbours with the same first member are counted together."""
    out, k = np.zeros(len(pairs)), 0
    for first, run in groupby(pairs, key=lambda p: p[0]):
        lane: list[str] = []
        for s in [p[1] for p in run] + [None]:
            if lane and (s is None or sum(map(len, lane)) + len(s) > LANES):
                out[k : k + len(lane)] -= u * np.array(distances(first, lane), float)
                k, lane = k + len(lane), []
            lane.append(s)
    return out


def scores_of(pairs: list[tuple[str, str]], matrix: np.ndarray, v: float, u: float, mode: str) -> np.ndarray:
    """``score_only`` of every pair, in groups."""
    if unit_costs(matrix, v, u, mode):
        return unit_scores(pairs, u)
    out = np.zeros(len(pairs))
    for at in groups(pairs):
        out[at] = together([pairs[i] for i in at], matrix, v, u, mode)
    return out


def paths_of(pairs: list[tuple[str, str]], matrix: np.ndarray, v: float, u: float, mode: str) -> list[tuple]:
    """``align`` of every pair, in groups; pairs of more than ``KEPT`` cells by themselves, without all their choices."""
    out: list[tuple] = [()] * len(pairs)
    for at in groups(pairs, KEPT):
        own = [pairs[i] for i in at]
        if len(own) == 1 and len(own[0][0]) * (len(own[0][1]) + 1) > KEPT:
            out[at[0]] = align(sequence_scorer(*own[0], matrix, v, u, mode))
            continue
        best, bi, bj, choices = together(own, matrix, v, u, mode, True)
        for k, i in enumerate(at):
            picks = choices[:, k]
            out[i] = (float(best[k]), *traced(int(bi[k]), int(bj[k]), mode, lambda r: (picks[r - 1] & 3, picks[r - 1] & 4, picks[r - 1] & 8)))
    return out


def path_statistics(a: str, b: str, runs, i: int, j: int) -> tuple[int, int, int, int]:
    """Matches, mismatches, gap openings and unpaired residues along a path."""
    mch = mmc = gap = unp = 0
    x, y = codes(a), codes(b)
    for op, n in runs:
        if op == "M":
            same = int((x[i : i + n] == y[j : j + n]).sum())
            mch, mmc = mch + same, mmc + n - same
        else:
            gap, unp = gap + 1, unp + n
        i += n if op != "I" else 0
        j += n if op != "D" else 0
    return mch, mmc, gap, unp


class Shuffles:
    """Seeded orders of texts: places by the digest of place and trial; the order of a shorter text is that of its places in a longer one."""

    def __init__(self, trials: int):
        self.trials, self.orders = trials, [np.zeros(0, np.int64)] * trials

    def of(self, s: str) -> list[str]:
        x = letter_codes(s)
        if len(x) > len(self.orders[0]):
            size = max(2 * len(self.orders[0]), len(x))
            for t in range(self.trials):
                keys = b"".join(md5(b"%d:%d" % (p, t + 1), usedforsecurity=False).digest() for p in range(1, size + 1))
                self.orders[t] = np.argsort(np.frombuffer(keys, "S16"), kind="stable")
        return [x[o[o < len(x)]].tobytes().decode("utf-32-le") for o in self.orders]


def shuffled(pairs: DataFrame, keys: str, trials: int) -> DataFrame:
    """Trials ``(keys..., trial, s1, s2)`` of every pair: 0 is the pair itself, the others have a seeded shuffle of its second member; spread by the cells to be scored."""
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders = Shuffles(trials)
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                many = part.loc[part.index.repeat(trials + 1)]
                texts = [x for s in part["s2"] for x in (s, *orders.of(s))]
                yield many[names].assign(trial=np.tile(np.arange(trials + 1, dtype=np.int32), len(part)), s1=many["s1"], s2=texts)

    spread = balanced(pairs, F.length("s1") * (trials + 1), F.length("s2"))
    return spread.mapInPandas(run, f"{keys}, trial int, s1 string, s2 string")


def pair_scores(pairs: DataFrame, keys: str, v: float = 9, u: float = 2, mode: str = "global", matrix: np.ndarray | None = None, spread: bool = False) -> DataFrame:
    """Score of every pair ``(keys..., s1, s2)``; ``keys`` is a DDL schema of the key columns.  Pairs that are ``spread`` already stay where they are."""
    m = letter_matrix() if matrix is None else matrix
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[names].assign(score=scores_of(list(zip(pdf["s1"], pdf["s2"])), m, v, u, mode))

    d = pairs if spread else balanced(pairs, F.length("s1"), F.length("s2"))
    return d.mapInPandas(run, f"{keys}, score double")


def pair_alignments(pairs: DataFrame, keys: str, v: float = 9, u: float = 2, mode: str = "global", matrix: np.ndarray | None = None) -> DataFrame:
    """Score, CIGAR path, start offsets and path statistics of every pair."""
    m = letter_matrix() if matrix is None else matrix
    names = [k.strip().split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            pairs = list(zip(pdf["s1"], pdf["s2"]))
            for (a, b), (best, runs, i, j) in zip(pairs, paths_of(pairs, m, v, u, mode)):
                rows.append((best, "".join(f"{n}{op}" for op, n in runs), i, j, *path_statistics(a, b, runs, i, j)))
            cols = ["score", "cigar", "start1", "start2", "mch", "mmc", "gap", "unp"]
            yield pd.concat([pdf[names].reset_index(drop=True), pd.DataFrame(rows, columns=cols)], axis=1)

    schema = f"{keys}, score double, cigar string, start1 long, start2 long, mch long, mmc long, gap long, unp long"
    return balanced(pairs, F.length("s1"), F.length("s2")).mapInPandas(run, schema)


def rescored(pairs: DataFrame, paths: DataFrame, keys: str, v: float = 9, u: float = 2, matrix: np.ndarray | None = None) -> DataFrame:
    """``(keys..., again)``: the score that the steps of each path add up to."""
    m = letter_matrix() if matrix is None else matrix
    names = [k.strip().split()[0] for k in keys.split(",")]

    def total(a: str, b: str, cigar: str, i: int, j: int) -> float:
        x, y, out = codes(a), codes(b), 0.0
        for n, op in re.findall("([0-9]+)([MDI])", cigar):
            n = int(n)
            out += m[x[i : i + n], y[j : j + n]].sum() if op == "M" else -v - u * n
            i, j = i + n * (op != "I"), j + n * (op != "D")
        return float(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[names].assign(again=[total(*x) for x in zip(pdf["s1"], pdf["s2"], pdf["cigar"], pdf["start1"], pdf["start2"])])

    return pairs.join(paths.select(*names, "cigar", "start1", "start2"), names).mapInPandas(run, f"{keys}, again double")


def balanced(pairs: DataFrame, m, n) -> DataFrame:
    """Spread pairs by their cost, the product ``m * n`` of two lengths: as many tasks as the cells need, and one per core at least."""
    cells = pairs.agg(F.sum(m.cast("double") * n)).first()[0] or 0.0
    return pairs.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, int(cells / TASK_CELLS) + 1))


def score_distance(score, self1, self2):
    """1 - score / geometric mean of the self scores, cut to 0..1."""
    d = 1 - score / F.sqrt(self1 * self2)
    return F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0))
