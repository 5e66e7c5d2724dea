"""Rooted trees, coordinate maps and split regions against plain recursion; empty input and ties."""

import math
import random
from collections import Counter, defaultdict

import pytest

from strandframe.operators import bipartitions as S, gap_maps as M, rooted as B

GROUPS = 4


def random_trees(seed, ties=False):
    """Binary trees by merging: nodes (grp, node, left, right, height, ndesc) and leaves."""
    rng = random.Random(seed)
    nodes, leaves = [], []
    for g in range(GROUPS):
        n = [1, 2, 5, 12][g]
        alive = [(k, 0.0, 1) for k in range(1, n + 1)]
        leaves += [(g, k) for k, _, _ in alive]
        h, step = 0.0, 0
        while len(alive) > 1:
            step += 1
            h += 1.0 if ties else rng.choice([0.0, 0.5, 1.25, 2.0])
            a, b = sorted(rng.sample(range(len(alive)), 2))
            x, y = alive[a], alive[b]
            alive = [v for i, v in enumerate(alive) if i not in (a, b)] + [(1000 + step, h, x[2] + y[2])]
            nodes.append((g, 1000 + step, x[0], y[0], h, x[2] + y[2]))
    return nodes, leaves


@pytest.fixture(scope="module", params=[(1, False), (2, True)])
def trees(spark, request):
    nodes, leaves = random_trees(*request.param)
    n = spark.createDataFrame(nodes, "grp long, node long, left long, right long, height double, ndesc long")
    return nodes, leaves, n, spark.createDataFrame(leaves, "grp long, node long")


def shape(nodes, leaves):
    kids = {(g, n): (a, b) for g, n, a, b, _, _ in nodes}
    height = {(g, n): h for g, n, _, _, h, _ in nodes}
    size = {(g, n): d for g, n, _, _, _, d in nodes} | {x: 1 for x in leaves}
    up = {(g, c): n for (g, n), cs in kids.items() for c in cs}
    return kids, height, size, up


def test_dollo(spark, trees):
    nodes, leaves, dn, dl = trees
    kids, _, size, up = shape(nodes, leaves)
    rng = random.Random(3)
    present = {(g, k, s) for g, k in leaves for s in range(9) if rng.random() < (0.9 if s == 0 else 0.35)}
    gain, loss = Counter(), Counter()

    def count(g, n, s):
        return int((g, n, s) in present) if (g, n) not in kids else sum(count(g, c, s) > 0 for c in kids[g, n])

    def walk(g, n, s, flag):
        stat = count(g, n, s)
        if not flag and (stat == 2 or ((g, n) not in kids and stat == 1)):
            gain[g, n] += 1
            flag = True
        elif flag and stat == 0:
            loss[g, n] += 1
            flag = False
        for c in kids.get((g, n), ()):
            walk(g, c, s, flag)

    for g, n in size:
        if (g, n) not in up:
            for s in range(9):
                walk(g, n, s, False)
    tree = B.branches(dn, dl)
    got = {(r.grp, r.node): (r.gain, r.loss) for r in B.dollo(tree, spark.createDataFrame(sorted(present) * 2, "grp long, node long, site long")).collect()}
    assert got == {x: (gain[x], loss[x]) for x in size}
    none = spark.createDataFrame([], "grp long, node long, site long")
    assert all(r.gain == r.loss == 0 for r in B.dollo(tree, none).collect()) and B.dollo(tree.limit(0), none).count() == 0


def test_pair_weights(trees):
    nodes, leaves, dn, dl = trees
    kids, height, size, up = shape(nodes, leaves)
    length = {(g, c): height[g, n] - height.get((g, c), 0.0) for (g, n), cs in kids.items() for c in cs}

    def res(g, n):
        if (g, n) not in kids:
            return 0.0
        a, b = (res(g, c) + length[g, c] for c in kids[g, n])
        return a * b / (a + b) if a > 0 and b > 0 else 0.0

    vol = {}

    def walk(g, n, ros, cur, above):
        if (g, n) not in kids:
            vol[g, n] = above * cur
            return
        l, r = kids[g, n]
        a, b = res(g, l) + length[g, l], res(g, r) + length[g, r]
        if ros is None:
            vol[g, n], cl, cr, rl, rr = 1.0, 1.0, 1.0, b, a
        elif ros <= 1e-7 or a + b <= 1e-7:
            vol[g, n], cl, cr, rl, rr = cur * above, 0.5, 0.5, 0.0, 0.0
        else:
            if a <= 0:
                a, b = 1e-7, b + a
            if b <= 0:
                a, b = a + b, 1e-7
            c = length[g, n] + ros
            both, whole = a * b / (a + b), a * b + a * c + b * c
            wa, wb = 1 + a * ros / ((both + c) * (a + c)), 1 + b * ros / ((both + c) * (b + c))
            bc, ac, ab = a * (b + c) / (whole * wb), b * (a + c) / (whole * wa), c * (a + b) / whole
            vol[g, n] = cur * math.sqrt(ac * bc / ab) * above
            cl, cr, rl, rr = math.sqrt(ab * ac / bc), math.sqrt(ab * bc / ac), b * ros / (b + ros), a * ros / (a + ros)
        walk(g, l, rl, cl, vol[g, n])
        walk(g, r, rr, cr, vol[g, n])

    for g, n in size:
        if (g, n) not in up and (g, n) in kids:
            walk(g, n, None, 1.0, 1.0)
    leaf, inner = B.pair_weights(B.branches(dn, dl))
    got = {(r.grp, r.node): r.weight for r in leaf.collect()} | {(r.grp, r.node): r.vol for r in inner.collect()}
    assert all(got[x] == pytest.approx(v, rel=1e-9, abs=1e-12) for x, v in vol.items())


def test_rooting(trees):
    nodes, leaves, dn, dl = trees
    kids, height, size, up = shape(nodes, leaves)
    tree = B.branches(dn, dl)
    for cut in (B.centres(tree.select("grp", "node", "parent", "length"), dl), B.balance_points(tree)):
        new = defaultdict(dict)
        for r in B.reroot(tree, cut).collect():
            new[r.grp][r.node] = (r.parent, r.length)
        assert new.pop(0) == {1: (None, None)}  # a single leaf has no branch and stays
        for g, t in new.items():
            def to_root(n):
                d = 0.0
                out = [(n, 0.0)]
                while t[n][0] is not None:
                    n, d = t[n][0], d + t[n][1]
                    out.append((n, d))
                return out

            depth = {n: to_root(n) for gg, n in leaves if gg == g}
            assert all(p[-1][0] == -1 for p in depth.values())
            # distances between leaves stay
            for a in depth:
                for b in depth:
                    if a < b:
                        x = dict(depth[a])
                        meet = next((n, d) for n, d in depth[b] if n in x)
                        anc = set()
                        n = a
                        while n is not None:
                            anc.add(n)
                            n = up.get((g, n))
                        n = b
                        while n not in anc:
                            n = up[g, n]
                        assert x[meet[0]] + meet[1] == pytest.approx(2 * height[g, n])


def test_centre_is_in_the_middle(trees):
    nodes, leaves, dn, dl = trees
    tree = B.branches(dn, dl)
    rows = {(r.grp, r.node): r for r in B.reroot(tree, B.centres(tree, dl)).collect()}
    for g in (1, 2, 3):
        deep = defaultdict(float)
        for gg, n in leaves:
            if gg == g:
                d, x = 0.0, n
                while rows[g, x].parent is not None:
                    d, last, x = d + rows[g, x].length, x, rows[g, x].parent
                deep[last] = max(deep[last], d)
        best = sorted(deep.values())[-2:]
        assert len(deep) == 2 and best[0] == pytest.approx(best[1])


@pytest.mark.parametrize("least,most", [(1, 2), (1, 4), (2, 5)])
def test_division(trees, least, most):
    nodes, leaves, dn, dl = trees
    kids, _, size, up = shape(nodes, leaves)

    def divide(g, n, extra, out):
        """Parts of the tree at n with whole subtrees carried along."""
        e = sum(size[g, x] for x in extra)
        if size[g, n] + e <= most or size[g, n] <= most:
            out.append([n, *extra])
            return
        c, d = sorted(kids[g, n], key=lambda x: (-size[g, x], x))
        small = size[g, d] if not extra else min(size[g, c], size[g, d] + e)
        if small > least:
            divide(g, c, [], out)
            divide(g, d, extra, out)
        elif size[g, c] <= most or (extra and size[g, c] <= size[g, d] + e):
            out.append([n, *extra])
        else:
            divide(g, c, [*extra, d], out)

    want = Counter()
    for g, n in size:
        if (g, n) not in up:
            out = []
            divide(g, n, [], out)
            want.update((g, tuple(sorted(p)), sum(size[g, x] for x in p) <= least) for p in out)
    got = defaultdict(list)
    for r in B.divide(dn, dl, least, most).collect():
        got[r.grp, r.part, r.outlier].append(r.node)
    assert Counter((g, tuple(sorted(v)), o) for (g, _, o), v in got.items()) == want
    assert sum(size[g, x] for (g, _, _), v in got.items() for x in v) == len(leaves)


def test_prune(trees):
    nodes, leaves, dn, dl = trees
    kids, height, size, up = shape(nodes, leaves)
    want = set()

    def walk(g, n):
        k = size[g, n]
        if k >= 4 or (k > 1 and height[g, n] <= 3.0 * (1 - 1 / k)):
            want.add((g, n, True))
        elif k == 1:
            want.add((g, n, False))
        else:
            for c in kids[g, n]:
                walk(g, c)

    for g, n in size:
        if (g, n) not in up:
            walk(g, n)
    assert {(r.grp, r.node, r.kept) for r in B.prune(dn, dl, 3.0, 4).collect()} == want
    assert B.prune(dn.limit(0), dl.limit(0), 3.0, 4).count() == 0 and B.divide(dn.limit(0), dl.limit(0), 1, 2).count() == 0


def random_row(rng, width):
    return "".join(rng.choice("AB---" if rng.random() < 0.5 else "ABC") for _ in range(width))


def test_maps_through_gaps(spark):
    rng = random.Random(8)
    rows = [(m, k, random_row(rng, 700 if m == 0 else 30)) for m in range(6) for k in range(3)] + [(7, 0, "----"), (7, 1, "-A--"), (8, 0, "")]
    keys = ["msa_id", "member"]
    runs, spans, want, folded = [], [], {}, {}
    for m, k, a in rows:
        spans.append((m, k, len(a)))
        p = 0
        while p < len(a):
            q = p
            while q < len(a) and (a[q] == "-") == (a[p] == "-"):
                q += 1
            if a[p] == "-":
                runs.append((m, k, p, q - p))
            p = q
        sites = [p + 1 for p, c in enumerate(a) if c != "-"]
        for l in range(1, len(sites) + 1, 4):
            r = min(len(sites), l + 5)
            want[m, k, l] = (sites[l - 1], sites[r - 1])
        for l in range(1, len(a) + 1, 3):
            inside = [i for i, s in enumerate(sites, 1) if l <= s <= l + 4]
            if inside:
                folded[m, k, l] = (inside[0], inside[-1])
    g = spark.createDataFrame(runs, "msa_id long, member long, gps int, gln int")
    w = spark.createDataFrame(spans, "msa_id long, member long, width int")
    maps = M.from_gaps(g, w, keys)
    iv = spark.createDataFrame([(m, k, i, i, min(i + 5, sum(c != "-" for c in a))) for m, k, a in rows for i in range(1, sum(c != "-" for c in a) + 1, 4)], "msa_id long, member long, i long, l long, r long")
    assert {(r.msa_id, r.member, r.i): (r.l, r.r) for r in M.image(iv, maps, keys, ["i"]).collect()} == want
    at = spark.createDataFrame([(m, k, i, i, i + 4) for m, k, a in rows for i in range(1, len(a) + 1, 3)], "msa_id long, member long, i long, l long, r long")
    assert {(r.msa_id, r.member, r.i): (r.l, r.r) for r in M.image(at, M.inverse(maps, keys), keys, ["i"]).collect()} == folded
    # a map after its inverse leaves everything in place, in one piece per run
    same = M.compose(maps, M.inverse(maps, keys), keys, keys).collect()
    assert all(r.x_l == r.y_l for r in same) and len(same) == len({(m, k) for m, k, a in rows if a.strip("-")})
    assert sorted(map(tuple, M.gaps_of(maps, keys).collect())) == sorted(x for x in runs if x[2] + x[3] < len({(m, k): a for m, k, a in rows}[x[0], x[1]]))
    none = [x.limit(0) for x in (g, w)]
    assert M.from_gaps(*none, keys).count() == 0 and M.common_gaps(*none, keys, "msa_id").count() == 0


def test_regions_of_small_and_empty_alignments(spark):
    cells = lambda rows: spark.createDataFrame([(m, k, p, c) for m, k, a in rows for p, c in enumerate(a, 1)], "msa_id long, member long, site long, r string")
    rows = [(1, k, "AAAAAAAA--CCCC") for k in range(4)] + [(2, 0, "AAAAAAAA")] + [(3, 0, "AAAAAAAA"), (3, 1, "CCCCCCCC")]
    c = cells(rows)
    tree = S.binary_tree(c.select("msa_id", "member").distinct(), 2)
    got = {(r.msa_id, r.l, r.r, r.conserved) for r in S.common_regions(c, tree, 12).collect()}
    assert got == {(1, 1, 14, True), (3, 1, 8, False)}  # a single member has no split
    fused = Counter((r.msa_id, r.size) for r in S.fused_groups(c, tree, 6).collect())
    assert fused == Counter({(1, 4): 4, (2, 1): 1, (3, 1): 2})
    assert S.common_regions(c.limit(0), tree.limit(0), 12).count() == 0 and S.fused_groups(c.limit(0), tree.limit(0), 6).count() == 0
