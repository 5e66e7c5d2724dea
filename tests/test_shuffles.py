"""Unit-cost scores counted in bits, and seeded shuffles made in a kernel."""

from hashlib import md5
from random import Random

import numpy as np
import pytest

from strandframe.operators import pairwise as P
from strandframe.plans import QUERIES


def unit(u=1.0):
    m = np.full((26, 26), -u)
    np.fill_diagonal(m, 0.0)
    return m


@pytest.mark.parametrize("lanes", [1, 90, 200_000])
@pytest.mark.parametrize("u", [1, 3])
def test_bits_equal_cells(lanes, u, monkeypatch):
    monkeypatch.setattr(P, "LANES", lanes)
    rng, pairs = Random(6), [("", ""), ("", "AC"), ("AC", ""), ("AC", "AC")]
    for _ in range(60):
        a = "".join(rng.choice("ACD") for _ in range(rng.randint(0, 90)))
        pairs += [(a, "".join(rng.choice("ACD") for _ in range(rng.randint(0, 90)))) for _ in range(rng.randint(1, 5))]
    want = [P.score_only(P.sequence_scorer(a, b, unit(u), 0, u, "global")) for a, b in pairs]
    assert P.unit_costs(unit(u), 0, u, "global") and P.scores_of(pairs, unit(u), 0, u, "global").tolist() == want
    assert not any(P.unit_costs(*x) for x in ((unit(), 0, 1, "local"), (unit(), 1, 1, "global"), (unit(), 0, 2, "global"), (P.letter_matrix(), 0, 1, "global"), (unit(0.5), 0, 0.5, "global")))


def test_unit_scores_take_no_cells(monkeypatch):
    """Every trial used to be scored cell by cell."""
    monkeypatch.setattr(P, "together", lambda *a: pytest.fail("cells"))
    assert P.scores_of([("ACDE", "ADE"), ("ACDE", "AAAA")], unit(), 0, 1, "global").tolist() == [-1, -3]


def test_shuffles_are_in_the_order_of_digests(spark):
    rows = [(1, 0, 1, "AC", "ABCDEFGHIJ"), (1, 2, 3, "A", "Q"), (2, 0, 1, "C", "ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3), (2, 2, 3, "C", "WXYZ")]
    d = spark.createDataFrame(rows, "msa_id long, i long, j long, s1 string, s2 string").coalesce(1)
    got = {(r.msa_id, r.i, r.trial): (r.s1, r.s2) for r in P.shuffled(d, "msa_id long, i long, j long", 8).collect()}
    want = {(k, i, t): (a, "".join(b[p] for p in sorted(range(len(b)), key=lambda p: md5(f"{p + 1}:{t}".encode()).hexdigest())) if t else b) for k, i, _, a, b in rows for t in range(9)}
    assert got == want


def test_no_digests_are_sorted_in_rows(spark):
    plan = QUERIES["shuffle_significance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "md5" not in plan and "array_sort" not in plan
