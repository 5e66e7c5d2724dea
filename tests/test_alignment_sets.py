"""Kernels over whole alignments against the cell-by-cell path and against pairs, and what their plans send to the driver."""

from collections import Counter, defaultdict
from random import Random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import alignment_columns as A
from strandframe.plans import QUERIES


def alignments(seed=3):
    """Alignments of no, one and several members, with null, empty and gap-only rows and letters beyond ASCII."""
    rng = Random(seed)
    rows = [(7, 0, None), (7, 1, "A-C"), (8, 0, ""), (8, 1, "--"), (9, 4, "QQ"), (-3, 0, "Ä𝒳A"), (-3, 1, "Ä-B")]
    for k in range(20, 45):
        for m in range(rng.randint(1, 6)):
            rows.append((k, m, "".join(rng.choice("ACDEW---") for _ in range(rng.randint(0, 40)))))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "msa_id long, member long, a string")


def joined_in_driver(df) -> list[str]:
    """Cells or words made in the plan that are sent whole through the driver, whatever their number."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    out = []
    for i, x in enumerate(plan):
        if "BroadcastExchange" in x:
            below = next((j for j in range(i + 1, len(plan)) if depth[j] <= depth[i]), len(plan))
            out += [y for y in plan[i + 1 : below] if "Generate" in y]
    return out


@pytest.mark.parametrize("alone", [0, 60, 500_000])
def test_distance_sums_equal_pairs(spark, alone):
    rows = alignments()
    cell = defaultdict(list)
    for k, m, a in rows:
        for i, c in enumerate(a or ""):
            if c != "-":
                cell[k, i].append((m, c))
    want = defaultdict(lambda: [0, 0])
    for (k, _), there in cell.items():
        for m, c in there:
            want[k, m][0] += sum(c != d for _, d in there)
            want[k, m][1] += len(there) - 1
    got = {(r.msa_id, r.member): [r.mismatches, r.shared] for r in A.member_distance_sums(frame(spark, rows), alone).collect()}
    assert got == dict(want)


@pytest.mark.parametrize("query", ["member_distance_sums", "member_outlier_report", "reverse_translation", "regions_over_splits", "fusible_groups"])
def test_no_cells_through_the_driver(spark, query):
    assert joined_in_driver(QUERIES[query](spark, "/root/testdata/sf0.1")) == []


@pytest.mark.parametrize("alone", [0, 60, 500_000])
def test_weighted_identity_equals_pairs(spark, alone):
    rows = alignments(5)
    weight = {(k, m): len((a or "").replace("-", "")) % 7 + 1 for k, m, a in rows}
    want, some = Counter(), set()
    for k, m, a in rows:
        for j, n, b in rows:
            if j == k and m < n:
                want[k] += weight[k, m] * weight[k, n] * sum(x == y != "-" for x, y in zip(a or "", b or ""))
        if (a or "").strip("-"):
            some.add(k)
    d = frame(spark, rows).withColumn("w", (F.length(F.translate(F.coalesce("a", F.lit("")), "-", "")) % 7 + 1).cast("long"))
    got = {r.msa_id: r.weighted_identity for r in A.weighted_identity(d, alone).collect()}
    assert got == {k: want[k] for k in some}


def test_weights_are_not_worked_out_for_each_cell(spark):
    """The weight of a member comes from its whole text: above the cells it would cost the square of the length."""
    plan = QUERIES["weighted_pair_identity"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Generate")[0] if "Generate" in plan else ""
    assert "length(translate" not in above


@pytest.mark.parametrize("alone", [0, 60, 500_000])
def test_reverse_translation_counts_columns(spark, alone):
    rows = alignments(7)
    usage = [("A", "GCA", 0.25), ("A", "GCC", 0.75), ("C", "TGC", 1.0), ("D", "GAC", 1.0), ("W", "TGG", 1.0)]
    many, want = Counter(k for k, _, _ in rows), defaultdict(float)
    for k, _, a in rows:
        for i, c in enumerate(a or "", 1):
            for aa, codon, share in usage:
                for p, b in enumerate(codon, 1):
                    if aa == c:
                        want[k, i, p, b] += share / many[k]
    found = A.reverse_translation(frame(spark, rows), spark.createDataFrame(usage, "aa string, codon string, share double"), alone).collect()
    got = {(r.msa_id, r.site, r.pos, r.base): r.freq for r in found}
    assert len(got) == len(found) and got == pytest.approx(dict(want))


@pytest.mark.parametrize("alone", [0, 60, 500_000])
def test_fused_members_equal_groups_of_cells(spark, alone, monkeypatch):
    from strandframe.operators import bipartitions as B

    monkeypatch.setattr(B, "NODE_CELLS", 50)
    rng, rows = Random(11), alignments(9)
    for k in range(50, 80):  # rows that agree in part, some long enough for stretches under the threshold
        base = [rng.choice("ACDEW-") for _ in range(rng.randint(0, 60))]
        for m in rng.sample(range(12), rng.randint(1, 9)):
            rows.append((k, m, "".join(c if rng.random() < 0.8 else rng.choice("ACDEW-") for c in base[: rng.randint(0, 80)])))
    d = frame(spark, rows)
    tree = B.binary_tree(d, 4).localCheckpoint()
    found = {}
    for threshold in (2, 6, 1000) if alone > 60 else (6,):
        want = sorted(map(tuple, B.fused_groups(A.cells_of(d), tree, threshold).collect()))
        assert sorted(map(tuple, B.fused_members(d, tree, threshold, alone=alone).collect())) == want
        found[threshold] = {(k, n) for k, _, n, _ in want}
    assert len({len(x) for x in found.values()}) == len(found)


def test_fused_members_are_not_cells(spark):
    """Every letter used to be shuffled once for each node above it."""
    assert "posexplode" not in QUERIES["fusible_groups"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("alone", [0, 60, 500_000])
@pytest.mark.parametrize("slots", [1, 3])
def test_columns_are_apportioned_by_largest_remainder(spark, alone, slots):
    rows, want = alignments(13), {}
    many, wide = Counter(k for k, _, _ in rows), defaultdict(Counter)
    for k, _, a in rows:
        for i, c in enumerate(a or "", 1):
            if c != "-":
                wide[k, i][c] += 1
    for (k, i), n in wide.items():
        n = n + Counter({"-": many[k] - sum(n.values())})
        num = {c: x * slots // many[k] for c, x in n.items()}
        for c in sorted(n, key=lambda c: (-(n[c] * slots % many[k]), c))[: slots - sum(num.values())]:
            num[c] += 1
        want[k, i] = "".join(c * num[c] for c in sorted(num))
    found = A.apportion(frame(spark, rows), slots, alone).collect()
    got = {(r.msa_id, r.site): r.column for r in found}
    assert got == want and len(found) == len(got)


def pairs_of(seed):
    """Pairs of rows of unlike lengths, and gaps put elsewhere in the same sequences."""
    rng, out = Random(seed), [(0, 0, 1, "", "", "", ""), (0, 2, 3, "AC", None, "AC", None), (0, 4, 5, "--", "AB", "", "AB"), (0, 6, 7, "Ä𝒳A-", "-ÄB", "Ä𝒳A", "ÄB")]

    def gapped(s):
        return "".join("-" * rng.choice((0, 0, 0, 1, 2)) + c for c in s)

    for k in range(1, 60):
        x = "".join(rng.choice("ACD") for _ in range(rng.randint(0, 30)))
        y = "".join(rng.choice("ACD") for _ in range(rng.randint(0, 30)))
        out.append((k, 2 * k, 2 * k + 1, gapped(x), gapped(y), gapped(x) if k % 2 else x, gapped(y) if k % 2 else y))
    return out


def facing(a, b):
    i = j = 0
    for x, y in zip(a or "", b or ""):
        i, j = i + (x != "-"), j + (y != "-")
        if x != "-" and y != "-":
            yield i, j


@pytest.mark.parametrize("cells", [1, 1_000_000])
def test_residue_maps_and_shared_segments(spark, cells, monkeypatch):
    monkeypatch.setattr(A, "PAIR_CELLS", cells)
    rows = pairs_of(17)
    d = spark.createDataFrame(rows, "msa_id long, i long, j long, a1 string, a2 string, b1 string, b2 string").coalesce(2)
    assert sorted(map(tuple, A.residue_maps(d).collect())) == sorted((k, i, j, *x) for k, i, j, a, b, _, _ in rows for x in facing(a, b))
    want = set()
    for k, i, j, a, b, c, e in rows:
        same = set(facing(a, b)) & set(facing(c, e))
        for x, y in same:
            if (x - 1, y - 1) not in same:
                want.add((k, i, j, x, y, next(n for n in range(1, 99) if (x + n, y + n) not in same)))
    got = list(map(tuple, A.shared_segments(d).collect()))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


@pytest.mark.parametrize("query", ["map_residues_between_members", "common_alignment_segments", "representative_reduction"])
def test_no_rows_of_cells_are_sorted_or_shuffled(spark, query):
    plan = QUERIES[query](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


@pytest.mark.parametrize("alone", [0, 60, 500_000])
def test_regions_equal_regions_of_cells(spark, alone, monkeypatch):
    from strandframe.operators import bipartitions as B

    monkeypatch.setattr(B, "NODE_CELLS", 50)
    rng, rows = Random(19), alignments(15) + [(90, 0, "ACDEW"), (90, None, "ACDEW"), (90, 1, "ACDEW"), (None, 0, "AC"), (None, 1, "AC")]
    for k in range(50, 90):  # rows that agree in part, some twice
        base = [rng.choice("ACDEW") for _ in range(rng.randint(0, 60))]
        for m in rng.sample(range(12), rng.randint(1, 9)):
            rows += [(k, m, "".join(c if rng.random() < 0.9 else rng.choice("ACDEW-") for c in base[: rng.randint(20, 80)]))] * rng.choice((1, 1, 1, 1, 2))
    d = frame(spark, rows)
    tree = B.binary_tree(d, 4).localCheckpoint()
    found = []
    for threshold in (4, 12) if alone > 60 else (8,):
        want = sorted(map(tuple, B.common_regions(A.cells_of(d), tree, threshold).collect()))
        assert sorted(map(tuple, B.regions(d, tree, threshold, alone=alone).collect())) == want
        found.append({x for x in want if x[3]})
    assert all(found) and len(set(map(len, found))) == len(found)


def test_regions_are_not_cells(spark):
    """Every letter used to be shuffled once for each split, and every site once for each."""
    plan = QUERIES["regions_over_splits"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan
