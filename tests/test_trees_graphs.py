"""Trees and graphs against sequential algorithms on small random inputs."""

import itertools
import random

import pytest

from strandframe.operators import graphs as G, trees as T
from strandframe.sources import matrices as M


def upgma(dist, sizes, method):
    clusters, heights = dict(sizes), []
    d = {frozenset(k): v for k, v in dist.items()}
    while len(clusters) > 1:
        pair = min(d, key=lambda k: (d[k], sorted(k)))
        a, b = sorted(pair)
        height = d.pop(pair)
        heights.append(round(height / 2, 9))
        for k in clusters:
            if k in (a, b):
                continue
            x, y = d.pop(frozenset((a, k))), d.pop(frozenset((b, k)))
            na, nb, nk = clusters[a], clusters[b], clusters[k]
            d[frozenset((a, k))] = {
                "upgma": (na * x + nb * y) / (na + nb), "single": min(x, y), "complete": max(x, y), "mean": (x + y) / 2,
                "ward": ((na + nk) * x + (nb + nk) * y - nk * height) / (na + nb + nk),
            }[method]
        clusters[a] += clusters.pop(b)
    return sorted(heights)


@pytest.mark.parametrize("method", ["upgma", "single", "complete", "mean", "ward"])
def test_linkage_heights(spark, method):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(2):
        pts = [(rng.random(), rng.random()) for _ in range(8)]
        dist = {(i, j): ((pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2) ** 0.5 for i, j in itertools.combinations(range(8), 2)}
        rows += [(g, i, j, d) for (i, j), d in dist.items()]
        want[g] = upgma(dist, {i: 1 for i in range(8)}, method)
    edges = spark.createDataFrame(rows, "grp int, i long, j long, d double")
    leaves = spark.createDataFrame([(g, i) for g in range(2) for i in range(8)], "grp int, node long")
    out = T.linkage(edges, leaves, method).collect()
    for g in want:
        assert sorted(round(r.height, 9) for r in out if r.grp == g) == pytest.approx(want[g])


def test_worked_upgma_example_and_newick(spark):
    """Distances 4 / 3 5 / 15 15 16: the first two join at 1.5, the outgroup last."""
    text = spark.createDataFrame([(0, "A B C D\n\n4\n3 5\n15 15 16")], "grp int, txt string")
    edges = M.distance_matrices(text, "grp", "txt").select("grp", "i", "j", "d")
    assert sorted((r.i, r.j, r.d) for r in edges.collect()) == [(0, 1, 4.0), (0, 2, 3.0), (0, 3, 15.0), (1, 2, 5.0), (1, 3, 15.0), (2, 3, 16.0)]
    leaves = spark.createDataFrame([(0, k) for k in range(4)], "grp int, node long")
    nodes = T.linkage(edges, leaves)
    assert sorted(round(r.height, 6) for r in nodes.collect()) == [1.5, 2.25, pytest.approx(46 / 6, abs=1e-5)]
    newick = T.newick_text(nodes, leaves)
    parsed = M.newick_nodes(newick, "grp", "newick").collect()
    assert {r.name for r in parsed if r.name} == {"0", "1", "2", "3"} and len(parsed) == 7
    weights = {r.leaf: r.weight for r in T.member_weights(nodes, leaves).collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and max(weights, key=weights.get) == 3
    cut = {r.leaf: r.cluster for r in T.cut_tree(nodes, leaves, 3.0).collect()}
    assert cut[0] == cut[1] == cut[2] != cut[3]
    coph = {(r.i, r.j): r.dist for r in T.cophenetic(nodes, leaves).collect()}
    assert coph[0, 2] == pytest.approx(3.0) and coph[0, 1] == pytest.approx(4.5)


def test_neighbour_joining_recovers_additive_tree(spark):
    # tree ((0:2,1:3):1,(2:4,3:1):2,4:5) as path lengths
    length = {0: 2, 1: 3, 2: 4, 3: 1, 4: 5}
    side = {0: ("x", 1), 1: ("x", 1), 2: ("y", 2), 3: ("y", 2), 4: ("z", 0)}
    rows = []
    for i, j in itertools.combinations(range(5), 2):
        inner = 0 if side[i][0] == side[j][0] else side[i][1] + side[j][1]
        rows.append((0, i, j, float(length[i] + length[j] + inner)))
    edges = spark.createDataFrame(rows, "grp int, i long, j long, d double")
    leaves = spark.createDataFrame([(0, k) for k in range(5)], "grp int, node long")
    br = T.neighbour_joining(edges, leaves).collect()
    got = {r.node: r.length for r in br if r.node < 5}
    assert {k: round(v, 6) for k, v in got.items()} == {k: float(v) for k, v in length.items() if k in got}
    assert sum(r.length for r in br) == pytest.approx(sum(length.values()) + 3)


def test_forest_equals_kruskal(spark):
    rng = random.Random(11)
    edges = {}
    for _ in range(120):
        u, v = rng.randint(0, 60), rng.randint(0, 60)
        if u != v:
            edges[min(u, v), max(u, v)] = float(rng.randint(1, 20))
    parent = list(range(61))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    kept = set()
    for d, u, v in sorted((d, u, v) for (u, v), d in edges.items()):
        if find(u) != find(v):
            parent[max(find(u), find(v))] = min(find(u), find(v))
            kept.add((u, v, d))
    df = spark.createDataFrame([(u, v, d) for (u, v), d in edges.items()], "u long, v long, dist double")
    assert {(r.u, r.v, r.dist) for r in G.spanning_forest(df).collect()} == kept
    label = {r.node: r.component for r in G.components(df).collect()}
    nodes = {x for e in edges for x in e}
    assert set(label) == nodes
    for a in nodes:
        assert label[a] == min(b for b in nodes if find(b) == find(a))


def test_long_path_component(spark):
    df = spark.createDataFrame([(k, k + 1) for k in range(200)], "u long, v long")
    assert {r.component for r in G.components(df).collect()} == {0}


def test_edge_list_similarity(spark):
    df = spark.createDataFrame([(1, 2, 5.0, 0), (2, 1, 9.0, 1), (3, 4, 8.0, 2), (5, 5, 9.0, 3), (1, 3, 1.0, 4)], "u long, v long, value double, k int")
    got = {(r.u, r.v): r.dist for r in G.edge_list(df, 4.0, ["k"], similarity=True).collect()}
    assert got == {(1, 2): 3.0, (3, 4): 0.0}
