"""Kernels over whole alignments in Java against rounds of jobs and against the pair kernel."""

from random import Random

import pytest
from pyspark.sql import functions as F

from strandframe import jvm as J
from strandframe.operators import pairwise as P, progressive as M
from strandframe.plans import QUERIES

SET = "msa_id long, member long, a string"


def drawn(rng, most, letters="ACDEW"):
    return "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))


def rows_of(d):
    return sorted(map(tuple, d.collect()), key=str)


def test_progressive_in_one_call_equals_rounds(spark):
    rng = Random(3)
    rows = [(s, m, m, drawn(rng, 30)) for s in range(24) for m in range(rng.choice((1, 2, 3, 4, 5, 6, 8)))]
    rows += [(50, 1, 0, "ACD"), (50, 2, 0, "ACC"), (50, 3, 9, "ACDE"), (51, 0, 3, ""), (51, 1, 8, ""), (52, 0, 2, ""), (52, 1, 3, "W")]
    loose = [(None, 0, 0, "AC"), (None, 1, 1, "A"), (60, 0, None, "AC"), (60, 1, 1, "A"), (60, 2, -1, "CC"), (61, 0, 0, None), (61, 1, 1, "AC")]
    df = spark.createDataFrame(rows + loose, "msa_id long, member long, g long, a string")
    got = rows_of(M.progressive(df))
    assert got == rows_of(M.progressive(df, alone=0)) == rows_of(M.progressive(df, alone=40))
    assert len(got) == len(rows) + len(loose) and {(s, m, a) for s, m, _, a in loose} <= set(got)
    assert sorted((s, m, (a or "").replace("-", "")) for s, m, a in got if s is not None) == sorted((s, m, a or "") for s, m, _, a in rows + loose if s is not None)
    assert M.progressive(df.limit(0)).count() == 0


def test_best_moves_in_one_call_equal_jobs(spark):
    rng = Random(5)
    rows = [(s, m, drawn(rng, 0) + "".join(rng.choice("ACD--") for _ in range(20))) for s in range(20) for m in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, SET)
    got = rows_of(M.best_moves(df))
    assert got == rows_of(M.best_moves(df, alone=0)) and len(got) > 5


def test_rows_without_text_are_not_refined(spark):
    rows = [(1, 0, "AC-D"), (1, 1, None), (1, 2, "A-CD"), (2, 0, None), (3, 0, "A"), (3, 1, "AC")]
    got = [{(r.msa_id, r.member): r.a for r in M.refine(spark.createDataFrame(rows, SET), alone=n).collect()} for n in (M.ALONE, 0)]
    assert got[0] == got[1] and got[0][1, 1] is None and got[0][2, 0] is None
    assert got[0][1, 0] == got[0][1, 2] == "ACD" and got[0][3, 0] == "A-"


def test_guests_in_one_call_equal_rounds(spark):
    rng = Random(8)
    rows = [(s, m, "".join(rng.choice("ACD-") for _ in range(15))) for s in range(20) for m in range(rng.randint(1, 5))] + [(30, None, "AC"), (None, 1, "A")]
    guests = [(s, m, drawn(rng, 20)) for s in range(5, 25) for m in rng.sample(range(-2, 6), rng.randint(1, 3))] + [(30, None, "ACC"), (31, 2, None), (None, 4, "CA")]
    df, g = spark.createDataFrame(rows, SET), spark.createDataFrame(guests, "msa_id long, member long, s string")
    got = rows_of(M.update_members(df, g))
    assert got == rows_of(M.update_members(df, g, alone=0)) and (None, 4, "CA") in got and (30, None, "ACC") in got


@pytest.mark.parametrize("seed", [1, 3])
def test_pairs_beyond_the_kept_choices(spark, seed):
    """Blocks of rows are worked out again where not all choices are kept (32 million)."""
    rng, m = Random(seed), P.letter_matrix()
    a = "".join(rng.choice("ACDEFGHIKL") for _ in range(6200))
    b = "".join(c for c in a if rng.random() < 0.9) + "W" * 300
    _, runs, _, _ = P.align(P.sequence_scorer(a, b, m, 9, 2, "global"))
    x, y = M.column_map(runs)
    want = ["".join(s[i - 1] if i else "-" for i in src) for s, src in ((a, x), (b, y))]
    df = spark.createDataFrame([(1, 0, 0, a), (1, 1, 1, b)], "msa_id long, member long, g long, a string")
    assert [r.a for r in M.progressive(df).orderBy("member").collect()] == want


@pytest.mark.parametrize("query", ["progressive_alignment", "progressive_alignment_consistency", "iterative_refinement", "iterative_refinement_consistency"])
def test_no_cells_and_no_python(spark, query):
    """Profiles used to be made of a row for each cell, shuffled in every round, and aligned in Python."""
    plan = QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "MapInPandas" not in plan


def test_costs_are_passed(spark):
    df = spark.createDataFrame([(1, 0, 0, "ACCD"), (1, 1, 1, "AD")], "msa_id long, member long, g long, a string")
    free = {r.member: r.a for r in M.progressive(df, v=0, u=0).collect()}
    assert free == {0: "ACCD", 1: "A--D"}
    assert J.dealt(df, 0, 1).groupBy(F.spark_partition_id()).count().count() == 1
