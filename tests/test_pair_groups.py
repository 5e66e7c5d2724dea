"""Pairs scored together against the same pairs one by one."""

from random import Random

import pytest

from strandframe.operators import pairwise as P


def drawn(rng, most):
    return "".join(rng.choice("ACDEFW") for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("mode", ["global", "local", "semiglobal"])
@pytest.mark.parametrize("v,u", [(9, 2), (0, 1), (2.5, 0.3)])
def test_groups_equal_single_pairs(mode, v, u, monkeypatch):
    rng, m = Random(11), P.letter_matrix()
    pairs = [(drawn(rng, 30), drawn(rng, 30)) for _ in range(150)] + [("", ""), ("A", ""), ("", "A"), ("W" * 40, "W")]
    pairs += [(a, a[2:7] + b) for a, b in pairs[:40]]
    monkeypatch.setattr(P, "ROW_CELLS", 300)
    monkeypatch.setattr(P, "KEPT", 700)  # some pairs are beyond it
    one = [P.align(P.sequence_scorer(a, b, m, v, u, mode)) for a, b in pairs]
    assert P.paths_of(pairs, m, v, u, mode) == one
    assert P.scores_of(pairs, m, v, u, mode).tolist() == [P.score_only(P.sequence_scorer(a, b, m, v, u, mode)) for a, b in pairs]


def test_short_pairs_share_their_rows():
    rng = Random(2)
    pairs = [(drawn(rng, 200), drawn(rng, 200)) for _ in range(200)]
    found = [list(g) for g in P.groups(pairs)]
    assert sorted(i for g in found for i in g) == list(range(200)) and len(found) <= 4


@pytest.mark.parametrize("mode", ["global", "local", "semiglobal"])
def test_small_pairs_take_one_pass(mode, monkeypatch):
    rng, m = Random(4), P.letter_matrix()
    pairs = [(drawn(rng, 60), drawn(rng, 60)) for _ in range(40)]
    steps, step = [0], P.Scorer.next
    monkeypatch.setattr(P.Scorer, "next", lambda *a: (steps.__setitem__(0, steps[0] + 1), step(*a))[1])
    found = [P.align(P.sequence_scorer(a, b, m, 9, 2, mode)) for a, b in pairs]
    assert steps[0] == sum(len(a) for a, _ in pairs)
    assert found == [P.align(P.sequence_scorer(a, b, m, 9, 2, mode), 0) for a, b in pairs]
