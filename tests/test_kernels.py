"""The alignment kernel against a cell-by-cell dynamic programme."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.operators import pairwise as P, progressive as M


def brute(a, b, m, v, u, mode):
    """Three-state affine recurrence, one cell at a time."""
    n1, n2, neg = len(a), len(b), -1e18
    h = np.full((n1 + 1, n2 + 1), neg)
    e, f = h.copy(), h.copy()
    h[0, 0] = 0
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            if i == 0 and j == 0:
                continue
            if i:
                e[i, j] = max(e[i - 1, j], h[i - 1, j] - v) - u
            if j:
                f[i, j] = max(f[i, j - 1], h[i, j - 1] - v) - u
            best = max(e[i, j], f[i, j])
            if i and j:
                best = max(best, h[i - 1, j - 1] + m[ord(a[i - 1]) - 65, ord(b[j - 1]) - 65])
            if mode != "global" and (i == 0 or j == 0):
                best = 0.0
            h[i, j] = max(best, 0.0) if mode == "local" else best
    if mode == "global":
        return h[-1, -1]
    return h.max() if mode == "local" else max(h[-1].max(), h[:, -1].max())


def path_score(a, b, runs, i, j, m, v, u):
    total = 0.0
    for op, n in runs:
        if op == "M":
            total += sum(m[ord(x) - 65, ord(y) - 65] for x, y in zip(a[i : i + n], b[j : j + n]))
        else:
            total -= v + u * n
        i += n if op != "I" else 0
        j += n if op != "D" else 0
    return total


@pytest.mark.parametrize("mode", ["global", "local", "semiglobal"])
@pytest.mark.parametrize("full", [10**9, 0])
def test_kernel_equals_brute_force(mode, full):
    rng, m = random.Random(5), P.letter_matrix()
    for _ in range(60):
        a = "".join(rng.choice("ACDEF") for _ in range(rng.randint(1, 14)))
        b = "".join(rng.choice("ACDEF") for _ in range(rng.randint(1, 14)))
        v, u = rng.choice([(9, 2), (3, 1), (0, 1)])
        s = P.sequence_scorer(a, b, m, v, u, mode)
        want = brute(a, b, m, v, u, mode)
        assert P.score_only(s) == pytest.approx(want), (a, b)
        score, runs, i, j = P.align(s, full)
        assert score == pytest.approx(want), (a, b)
        assert path_score(a, b, runs, i, j, m, v, u) == pytest.approx(want), (a, b, runs)


def test_score_is_symmetric_and_reversible():
    m = P.letter_matrix()
    a, b = "ACDEFGHIKL", "ACDFGHHIKLM"
    s = P.score_only(P.sequence_scorer(a, b, m, 9, 2, "global"))
    assert s == P.score_only(P.sequence_scorer(b, a, m, 9, 2, "global"))
    assert s == P.score_only(P.sequence_scorer(a[::-1], b[::-1], m, 9, 2, "global"))


def test_progressive_and_refinement(spark):
    rows = [(1, k, k, s) for k, s in enumerate(["ACDEFGHIK", "ACDEGHIK", "CDEFGHIKL", "ACDEFGHI", "ADEFGHIK"])] + [(2, 0, 0, "MNPQ"), (3, 0, 0, "AAAA"), (3, 1, 1, "AAA")]
    df = spark.createDataFrame(rows, "msa_id long, member long, g long, a string")
    out = M.refine(M.progressive(df))
    assert M.best_moves(out).count() == 0
    got = {(r.msa_id, r.member): r.a for r in out.collect()}
    assert {k: v.replace("-", "") for k, v in got.items()} == {(r[0], r[1]): r[3] for r in rows}
    for msa in (1, 2, 3):
        assert len({len(v) for k, v in got.items() if k[0] == msa}) == 1
    assert got[3, 1].count("-") == 1


def test_group_alignment_of_identical_profiles(spark):
    df = spark.createDataFrame([(1, k, k, "ACDEFG") for k in range(4)], "msa_id long, member long, g long, a string")
    assert {r.a for r in M.progressive(df).collect()} == {"ACDEFG"}
