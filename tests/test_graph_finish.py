"""Forests and components whose rest is finished in one task, against those of rounds alone."""

import random

import pytest

from strandframe.operators import graphs as G


@pytest.mark.parametrize("finish", [0, 12, 500])
def test_forest_is_the_same_wherever_the_rounds_end(spark, monkeypatch, finish):
    monkeypatch.setattr(G, "FINISH", finish)
    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
    pairs = [(a + 100 * k, b + 100 * k, float(rng.randrange(4))) for k in range(2) for a, b in sorted(pairs)]
    edges = spark.createDataFrame(pairs, "u long, v long, dist double")
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    want = set()
    for d, u, v in sorted((d, u, v) for u, v, d in pairs):
        a, b = root(u), root(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
            want.add((u, v, d))
    forest = G.spanning_forest(edges)
    assert sorted(map(tuple, forest.collect())) == sorted(want)
    groups = {}
    for x in {x for u, v, _ in pairs for x in (u, v)}:
        groups.setdefault(root(x), set()).add(x)
    trees = {c: (len(m), max(d for u, _, d in want if root(u) == c), sum(d for u, _, d in want if root(u) == c)) for c, m in groups.items()}
    assert {r.component: (r["size"], r.height, r.length) for r in G.forest_report(forest).collect()} == trees


def test_a_small_graph_takes_few_jobs(spark, monkeypatch):
    """Rounds of a path of 600 nodes took some thirty checkpoints."""
    made = []
    monkeypatch.setattr(G, "cut_lineage", lambda df, cut=G.cut_lineage: made.append(1) or cut(df))
    edges = spark.createDataFrame([(i, i + 1, float(i % 7)) for i in range(600)], "u long, v long, dist double")
    assert [tuple(r) for r in G.forest_report(G.spanning_forest(edges)).select("component", "size").collect()] == [(0, 601)]
    assert len(made) <= 5
