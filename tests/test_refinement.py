"""Refinement: the score of a member against the rest pair by pair, gains that only rise, one task or many jobs."""

import random

import numpy as np
import pytest

from strandframe.operators import pairwise as P, progressive as M

MATRIX, V, U = P.letter_matrix(), 9, 2


def pair_score(x, y):
    """Projected pair score of two aligned rows: columns with two gaps don't count."""
    total, kind = 0.0, ""
    for a, b in zip(x, y):
        if a == b == "-":
            continue
        if a != "-" and b != "-":
            total, kind = total + MATRIX[ord(a) - 65, ord(b) - 65], ""
        else:
            now = "a" if a == "-" else "b"
            total, kind = total - U - (V if now != kind else 0), now
    return total


def whole_score(rows):
    return sum(pair_score(x, y) for i, x in enumerate(rows) for y in rows[:i])


def random_rows(rng, many, width):
    return ["".join(rng.choice("ACDE--" if rng.random() < 0.7 else "-") for _ in range(width)) for _ in range(many)]


def described(rows):
    own = [M.letters_of(t) for t in rows]
    profile, gaps, late = np.zeros((len(rows[0]), 26)), [], []
    for o in own:
        gap, before = M.states_of(o)
        for p in range(len(o)):
            if gap[p]:
                gaps.append((p, before[p], 1))
            else:
                profile[p, o[p]] += 1
                if before[p]:
                    late.append((p, before[p], 1))
    cols = lambda x: tuple(np.array(c, np.int64) for c in (zip(*x) if x else ((), (), ())))
    return own, profile, cols(gaps), cols(late)


@pytest.mark.parametrize("seed", range(150))
def test_score_against_the_rest(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, rng.randint(2, 6), rng.randint(1, 14))
    own, profile, gaps, late = described(rows)
    k = rng.randrange(len(rows))
    others = [r for i, r in enumerate(rows) if i != k]
    rest = M.Rest(profile, len(rows), gaps, late, own[k])
    sites = np.flatnonzero(own[k] >= 0)
    sim = rest.profile @ MATRIX[:, own[k][sites]] if len(sites) else np.zeros((len(rest.cols), 0))
    # any placement: the kept columns and the letters in their orders, shuffled together
    for _ in range(4):
        c, j, ops, new, spread = 0, 0, [], "", ["" for _ in others]
        while c < len(rest.cols) or j < len(sites):
            op = rng.choice([x for x, ok in ((0, c < len(rest.cols) and j < len(sites)), (1, c < len(rest.cols)), (2, j < len(sites))) if ok])
            new += "-" if op == 1 else rows[k][sites[j]]
            spread = [s + ("-" if op == 2 else r[rest.cols[c]]) for s, r in zip(spread, others)]
            ops, c, j = ops + [op], c + (op != 2), j + (op != 1)
        got = rest.score(np.array(ops, np.int64), sim, V, U)
        assert got == pytest.approx(sum(pair_score(new, s) for s in spread))


@pytest.mark.parametrize("seed", range(8))
def test_every_move_raises_the_whole(seed):
    rng = random.Random(seed)
    rows = random_rows(rng, 5, 12)
    want = [r.replace("-", "") for r in rows]
    seen = [whole_score(rows)]
    while True:
        own, profile, gaps, late = described(rows)
        moves = [(b[0], -i, b[1], b[2]) for i, o in enumerate(own) if (b := M.realign(profile, len(rows), gaps, late, o, MATRIX, V, U))]
        if not moves:
            break
        gain, k, rest, mine = max(moves, key=lambda x: x[:2])
        rows = ["".join(t[x - 1] if x else "-" for x in (mine if i == -k else rest)) for i, t in enumerate(rows)]
        seen.append(whole_score(rows))
        assert seen[-1] == pytest.approx(seen[-2] + gain) and seen[-1] > seen[-2]
    assert [r.replace("-", "") for r in rows] == want


def test_one_task_and_many_jobs_agree(spark):
    rng = random.Random(7)
    rows = [(s, k, a) for s in range(5) for k, a in enumerate(random_rows(rng, s + 1, 10))] + [(9, 0, ""), (9, 1, "")]
    df = spark.createDataFrame(rows, "msa_id long, member long, a string")
    got = [{(r.msa_id, r.member): r.a for r in M.refine(df, alone=n).collect()} for n in (M.ALONE, 0)]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    for s in range(5):
        before = [a for m, _, a in rows if m == s]
        after = [got[0][s, k] for k in range(len(before))]
        assert whole_score(after) >= whole_score(before)
    assert M.best_moves(spark.createDataFrame([(*k, a) for k, a in got[0].items()], "msa_id long, member long, a string")).count() == 0
    assert M.refine(df.limit(0)).count() == 0


def test_members_replaced_and_added(spark):
    rows = [(1, 0, "ACDE-FGH"), (1, 1, "ACDEXFGH"), (1, 2, "A-DE-FGH"), (2, 0, "AC-"), (3, 0, "--A"), (4, 0, "CC"), (4, 1, "C-")]
    guests = [(1, 1, "ACDEFGH"), (1, 7, "ACDFGH"), (3, 0, "KLM"), (4, 0, ""), (4, 5, None), (9, 0, "NEW")]
    df = spark.createDataFrame(rows, "msa_id long, member long, a string")
    g = spark.createDataFrame(guests, "msa_id long, member long, s string")
    got = {(r.msa_id, r.member): r.a for r in M.update_members(df, g).collect()}
    assert got[1, 0] == "ACDEFGH" and got[1, 1] == "ACDEFGH" and got[1, 2] == "A-DEFGH"  # the column of the old member is gone
    assert got[1, 7].replace("-", "") == "ACDFGH" and len(got[1, 7]) == len(got[1, 0])
    assert got[2, 0] == "AC-" and got[3, 0] == "KLM" and got[9, 0] == "NEW"
    assert got[4, 1] == "C" and got[4, 0] == got[4, 5] == "-"
    same = {(r.msa_id, r.member): r.a for r in M.update_members(df, g.limit(0)).collect()}
    assert same == {(m, k): a for m, k, a in rows}
