"""Search, intervals and outliers against brute force on skewed fixtures."""

import random
from collections import Counter

import pytest

from strandframe.operators import chaining as C, intervals as I, statistics as S, word_join as J


def words(s, k):
    return Counter(s[i : i + k] for i in range(len(s) - k + 1))


@pytest.mark.parametrize("t", [0.3, 0.5, 0.8])
def test_similarity_is_exact(spark, t):
    rng = random.Random(1)
    base = ["".join(rng.choice("ABCD") for _ in range(rng.randint(3, 60))) for _ in range(25)]
    db = base + [b[: len(b) // 2] + "".join(rng.choice("ABCD") for _ in range(10)) for b in base] + [base[0]] * 30
    qs = [b[3:40] for b in base[:12]] + ["AAAAAAAAAA", "AB"]
    q = spark.createDataFrame(list(enumerate(qs)), "q_id long, s string")
    d = spark.createDataFrame(list(enumerate(db)), "seq_id long, s string")
    want = set()
    for i, a in enumerate(qs):
        for j, b in enumerate(db):
            wa, wb = words(a, 3), words(b, 3)
            if wa and wb:
                shared = sum(min(n, wb[w]) for w, n in wa.items())
                if shared >= t * min(sum(wa.values()), sum(wb.values())) - 1e-9:
                    want.add((i, j, shared))
    got = {(r.q_id, r.seq_id, r.shared) for r in J.similar_sequences(q, d, 3, t).collect()}
    assert got == {w for w in want if w[2] > 0}


def test_chain_prefers_collinear_hits(spark):
    hits = spark.createDataFrame(
        [(1, 1, 1, 1, 10), (1, 1, 20, 21, 10), (1, 1, 15, 300, 12), (1, 1, 40, 41, 5)], "q_id long, seq_id long, q_start long, d_start long, len long"
    )
    got = C.chains(hits).orderBy("k").collect()
    assert [(r.k, r.q_start) for r in got] == [(1, 1), (2, 20), (3, 40)] and got[0].score == pytest.approx(25 - 3.1)
    assert C.chains(hits.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(120))
def test_chain_against_all_predecessors(seed):
    rng = random.Random(seed)
    n, wide = rng.randint(1, 40), rng.choice([30, 300])
    hits = sorted((rng.randint(1, wide), rng.randint(1, wide), rng.randint(3, 20)) for _ in range(n))
    qs, ds, ln = (list(x) for x in zip(*hits))
    score, count = [], []
    for i in range(n):
        best, at = 0, -1
        for j in range(i):
            over = max(0, qs[j] + ln[j] - qs[i], ds[j] + ln[j] - ds[i])
            if qs[j] < qs[i] and ds[j] < ds[i] and qs[j] + ln[j] < qs[i] + ln[i] and ds[j] + ln[j] < ds[i] + ln[i] and 2 * over <= min(ln[i], ln[j]):
                shift = abs(ds[j] - qs[j] - ds[i] + qs[i])
                g = score[j] - 10 * over - (30 + shift if shift else 0)
                if g > best:
                    best, at = g, j
        score.append(10 * ln[i] + best)
        count.append(1 + (count[at] if at >= 0 else 0))
    top, path = C.best_chain(qs, ds, ln)
    assert top == max(score) and len(path) == count[score.index(top)]


def brute_union(iv):
    out = []
    for l, r in sorted(iv):
        if out and l <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r)
        else:
            out.append([l, r])
    return {tuple(x) for x in out}


def test_interval_sets_with_one_hot_key(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 3), l, l + rng.randint(1, 30)) for l in (rng.randint(0, 3000) for _ in range(300))]
    df = spark.createDataFrame(rows, "k long, l long, r long")
    u = I.union(df, ["k"], 50).collect()
    for k in {r[0] for r in rows}:
        assert {(r.l, r.r) for r in u if r.k == k} == brute_union([x[1:] for x in rows if x[0] == k])
    other = spark.createDataFrame([(k, l + 7, r + 3) for k, l, r in rows[::3]], "k long, l long, r long")
    both = I.intersection(df, other, ["k"], 50).collect()
    inside = {(k, x) for k, l, r in rows for x in range(l, r)} & {(k, x) for k, l, r in rows[::3] for x in range(l + 7, r + 3)}
    assert {(r.k, x) for r in both for x in range(r.l, r.r)} == inside
    gaps = I.complement(df, ["k"], 50, 0, 4000).collect()
    covered = {(k, x) for k, l, r in rows for x in range(l, r)}
    assert {(r.k, x) for r in gaps for x in range(r.l, r.r)} == {(k, x) for k in {r[0] for r in rows} for x in range(4000)} - covered


def test_dixon_recursion(spark):
    data = [(1, k, float(v)) for k, v in enumerate([10, 11, 10.5, 11.2, 10.8, 60, 200])] + [(2, k, float(k)) for k in range(5)]
    df = spark.createDataFrame(data, "g int, id long, x double")
    got = {(r.g, r.id) for r in S.dixon_recursive(df, ["g"], ["id"], "x").collect()}
    assert got == {(1, 6), (1, 5)}
