"""Splice signals, sliding sums and weight matrices by kernels over Arrow batches, against plain loops."""

import random

from strandframe.operators import signals as S, windows as W

PART = S.Frechet(1.0, 0.0, 6.0, 2.0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_best_acceptor_without_a_window_or_a_shuffle(spark):
    rng = random.Random(5)
    texts = ["", "G", "GT", "GTAG", "ATAC"] + ["".join(rng.choices("ACGT", k=rng.randrange(5, 80))) for _ in range(25)]
    d = spark.createDataFrame(list(enumerate(texts)), "seq_id long, s string")
    got = S.paired_signals(d, PART, 4, 25)
    assert "Exchange" not in plan(got) and "Window" not in plan(got)
    n = spark.range(4, 26)
    score = {r[0]: r[1] for r in n.select("id", S.length_penalty(n["id"], [PART], 4, 25)).collect()}
    want = {}
    for i, s in enumerate(texts):
        for p in range(len(s) - 1):
            all_ = [(round(2 * S.DONORS[s[p : p + 2]] + score[q + 2 - p], 6), p - q, q + 1) for q in range(len(s) - 1)
                    if s[p : p + 2] in S.DONORS and S.ACCEPTORS.get(s[q : q + 2]) == S.DONORS[s[p : p + 2]] and 4 <= q + 2 - p <= 25]
            if all_:
                best = max(all_)
                want[i, p + 1] = (best[2], best[2] + 1 - p, S.DONORS[s[p : p + 2]], best[0])
    assert {(r.seq_id, r.donor): (r.acceptor, r.len, r.level, round(r.score, 6)) for r in got.collect()} == want and len(want) > 50


def test_sliding_sums_and_matrices_leave_the_lambdas(spark):
    rng = random.Random(6)
    texts = [None, "", "ACG", "ACGT" * 3] + ["".join(rng.choices("ACGT", k=rng.randrange(1, 60))) for _ in range(20)]
    d = spark.createDataFrame(list(enumerate(texts)), "seq_id long, s string")
    values, width, matrix = {"A": 3, "C": -2, "G": 1}, 5, [(3, 1, 2, 0), (-9, 4, 0, 1), (0, 0, 5, -1)]
    sums, hits = {}, {}
    for i, s in enumerate(texts):
        v = [sum(values.get(x, 0) for x in s[k : k + width]) for k in range(len(s) - width + 1)] if s else []
        if v:
            sums[i] = (max(v), min(v), v.index(max(v)) + 1 + width // 2)
        w = [sum(c["ACGT".index(x)] for c, x in zip(matrix, s[k:])) for k in range(len(s) - 2)] if s else []
        if w:
            hits[i] = (max(w), w.index(max(w)) + 1)
    a, b = W.sliding_extremes(d, values, width), W.weight_matrix_hits(d, "ACGT", matrix)
    assert {r[0]: tuple(r)[1:] for r in a.collect()} == sums
    assert {r[0]: tuple(r)[1:] for r in b.collect()} == hits
    assert all("lambdafunction" not in plan(x) for x in (a, b))
