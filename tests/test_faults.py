"""Faults found before: one small test each."""

import re

from strandframe.functions import residues as R
from strandframe.operators import alignment_columns as A, orf as O, trees as T


def cells(spark, rows):
    from pyspark.sql import functions as F

    r = spark.createDataFrame(rows, "msa_id long, member long, role string, a string")
    c = r.select("msa_id", "member", "role", F.posexplode(F.split("a", "")).alias("p", "r")).filter("r != ''")
    return r, c.select("msa_id", "member", "role", (F.col("p") + 1).cast("long").alias("site"), "r")


def test_consensus_keeps_every_site(spark):
    r, c = cells(spark, [(1, 0, "u", "AC--G"), (1, 1, "u", "AC--G"), (2, 0, "u", ""), (3, 0, "u", "--")])
    assert {x["msa_id"]: x["consensus"] for x in A.consensus(c, r).collect()} == {1: "ACXXG", 3: "XX"}


def test_orf_of_every_frame(spark):
    s = "CATGAAATAGC" + "ATG" + "C" * 30
    d = spark.createDataFrame([(1, s), (2, ""), (3, None)], "seq_id long, s string")
    got = {(r["frame"], r["pos"], r["len"]) for r in O.open_reading_frames(d, 6).collect()}
    assert got == {(1, 1, 6), (2, 11, 33)}
    between = {(r["frame"], r["pos"], r["len"]) for r in O.open_reading_frames(d, 6, False).collect()}
    assert between == {(1, 0, 7), (1, 10, 34), (0, 0, 44), (2, 5, 39)}
    plan = O.open_reading_frames(d, 6)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan


def test_tree_ids_over_32_bits_and_no_edges(spark):
    big = 2**32 + 5
    e = spark.createDataFrame([(1, 1, 2, 0.2), (1, 1, big, 0.6), (1, 2, big, 0.6)], "grp int, i long, j long, d double")
    leaves = spark.createDataFrame([(1, 1), (1, 2), (1, big)], "grp int, node long")
    nodes = T.linkage(e, leaves).collect()
    assert {(r["left"], r["right"]) for r in nodes if r["ndesc"] == 2} == {(1, 2)} and len({r["node"] for r in nodes} | {1, 2, big}) == 5
    nj = T.neighbour_joining(e, leaves).collect()
    assert all(r["node"] != r["parent"] and r["length"] >= 0 for r in nj)
    none = e.limit(0)
    assert T.linkage(none, leaves).collect() == [] == T.neighbour_joining(none, leaves).collect()
    assert T.leaf_memberships(T.linkage(none, leaves), leaves).collect() == []


def test_pattern_class_letters():
    def hits(p, s):
        return [m.start() for m in re.finditer(f"(?={R.prosite_regex(p)})", s)]

    assert hits("o-x-$", "CAFDAF") == [0] and hits("j(2)-+", "DEKAA") == [0] and hits("[@P]-{+}", "PKPA") == [2] and hits("A-..", "AGAC") == [0]
    assert R.prosite_regex("[ST]-x(2)-{P}-R") == "[ST].{2}[^P]R"


def test_statistic_lines_round_like_printf(spark):
    """Ties and near ties of the fourth digit are rounded by their binary value, as the SQL's printf and C do."""
    from pyspark.sql import functions as F

    from strandframe.sinks.writers import fixed4, statistic_line

    ties = [29 / 32, 0.03125, 0.09375, 0.94375, 0.00005, 0.00015, 0.12345, 0.99995, 1.0, 0.0, 1e-9, 0.5, -0.03125, 255.99995, 1000.25, 2 / 3]
    ties += [k / 20000 for k in range(1, 20000, 2)] + [k / 7919 for k in range(7919)]
    rows = spark.createDataFrame([(x,) for x in ties], "x double").select("x", fixed4(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in rows if r.t != f"{r.x:.4f}"] == []
    line = spark.createDataFrame([(29 / 32, 6, 13, 7, 197)], "d double, a long, b long, c long, e long").select(statistic_line(*[F.col(c) for c in "dabce"]).alias("s")).first().s
    assert line == "  0.9062      6     13      7    197"
