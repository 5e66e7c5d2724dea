"""Dynamic-programming queries: consecutive turns as pairs, conversations as member sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from strandframe.functions import residues as R
from strandframe.operators import alignment_columns as A, pairwise as P, progressive as M
from strandframe.plans.fragments import ROWS
from strandframe.plans.registry import query
from strandframe.session import cut_lineage

PAIR = f"""{ROWS}, prs AS (SELECT x.msa_id, x.member AS i, y.member AS j, replace(x.a, '-', '') AS s1, replace(y.a, '-', '') AS s2
FROM rws x JOIN rws y ON x.msa_id = y.msa_id AND x.member % 2 = 0 AND y.member = x.member + 1)"""
KEYS = "msa_id long, i long, j long"


def sequence_pairs(t):
    return A.consecutive_pairs(t.rows).select("msa_id", "i", "j", R.ungap("a1").alias("s1"), R.ungap("a2").alias("s2"))


@query("D1 J4", f"WITH {PAIR} SELECT msa_id, i, j, CAST(levenshtein(s1, s2) AS INTEGER) AS distance FROM prs")
def edit_distance(t):
    return sequence_pairs(t).select("msa_id", "i", "j", F.levenshtein("s1", "s2").alias("distance"))


@query("D1 D3 D23", f"WITH {PAIR} SELECT msa_id, i, j, CAST(-levenshtein(s1, s2) AS DOUBLE) AS score FROM prs")
def unit_cost_alignment_score(t):
    unit = np.full((26, 26), -1.0)
    np.fill_diagonal(unit, 0.0)
    return P.pair_scores(sequence_pairs(t), KEYS, v=0, u=1, mode="global", matrix=unit)


@query("D3 D20 F10 F14")
def affine_alignment_score(t):
    return P.pair_scores(sequence_pairs(t), KEYS)


@query("D4 D5 D16 D21 D22 K10")
def affine_alignment_path(t):
    return P.pair_alignments(sequence_pairs(t), KEYS)


@query("D6")
def local_alignment_path(t):
    return P.pair_alignments(sequence_pairs(t), KEYS, mode="local")


@query("D3")
def semiglobal_alignment_score(t):
    return P.pair_scores(sequence_pairs(t), KEYS, mode="semiglobal")


@query("F12 F13 E16 P21")
def alignment_score_distance(t):
    pairs = sequence_pairs(t)
    scores = P.pair_scores(pairs, KEYS)
    self1, self2 = F.length("s1") * 4, F.length("s2") * 4
    return pairs.filter("s1 != '' AND s2 != ''").join(scores, ["msa_id", "i", "j"]).select(
        "msa_id", "i", "j", F.round(P.score_distance(F.col("score"), self1, self2), 6).alias("dist")
    )


@query("D19 I8", f"""WITH {PAIR}, tr AS (SELECT unnest(range(0, 9)) AS n),
q AS (SELECT msa_id, i, j, s1, n, unnest(string_split(s2, '')) AS y, CAST(unnest(range(1, length(s2) + 1)) AS BIGINT) AS p FROM prs, tr WHERE s1 <> '' AND s2 <> ''),
m AS (SELECT msa_id, i, j, n, -levenshtein(any_value(s1), string_agg(y, '' ORDER BY CASE WHEN n = 0 THEN lpad(CAST(p AS VARCHAR), 12, '0') ELSE md5(p || ':' || n) END, p)) AS s FROM q GROUP BY ALL),
g AS (SELECT msa_id, i, j, CAST(max(s) FILTER (n = 0) AS DOUBLE) AS score, avg(s) FILTER (n > 0) AS mean, stddev_samp(s) FILTER (n > 0) AS sd FROM m GROUP BY ALL)
SELECT msa_id, i, j, score, round(mean, 6) AS mean, round(sd, 6) AS sd, CASE WHEN sd > 0 THEN round((score - mean) / sd, 6) END AS z FROM g""")
def shuffle_significance(t):
    """Alignment score of a pair against eight seeded shuffles of its whole second member, and the z of it."""
    trials = P.shuffled(sequence_pairs(t).filter("s1 != '' AND s2 != ''"), KEYS, 8)
    unit = np.full((26, 26), -1.0)
    np.fill_diagonal(unit, 0.0)
    s = P.pair_scores(trials, f"{KEYS}, trial int", v=0, u=1, matrix=unit, spread=True)
    shuffled = F.when(F.col("trial") > 0, F.col("score"))
    g = s.groupBy("msa_id", "i", "j").agg(F.max(F.when(F.col("trial") == 0, F.col("score"))).alias("score"), F.avg(shuffled).alias("mean"), F.stddev_samp(shuffled).alias("sd"))
    z = F.when(F.col("sd") > 0, F.round((F.col("score") - F.col("mean")) / F.col("sd"), 6))
    return g.select("msa_id", "i", "j", "score", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), z.alias("z"))


def _members(t):
    return t.rows.select("msa_id", "member", F.col("member").alias("g"), R.ungap("a").alias("a"))


@query("I1 D8 D13 D17")
def progressive_alignment(t):
    return M.progressive(_members(t))


@query("I1 J21", f"""WITH {ROWS} SELECT msa_id, member, replace(a, '-', '') AS residues, true AS same_width FROM rws""")
def progressive_alignment_consistency(t):
    """Every aligned row gives back its sequence and all rows of a set have one width."""
    d = cut_lineage(M.progressive(_members(t)))
    width = d.groupBy("msa_id").agg((F.max(F.length("a")) == F.min(F.length("a"))).alias("same_width"))
    return d.join(width, "msa_id").select("msa_id", "member", R.ungap("a").alias("residues"), "same_width")


@query("I3 T3")
def iterative_refinement(t):
    return M.refine(M.progressive(_members(t)))


@query("I3 J21", f"""WITH {ROWS} SELECT msa_id, member, replace(a, '-', '') AS residues, true AS same_width, true AS settled FROM rws""")
def iterative_refinement_consistency(t):
    """Refined rows give back their sequences, have one width per set, and no move gains any more."""
    d = cut_lineage(M.refine(M.progressive(_members(t))))
    width = d.groupBy("msa_id").agg((F.max(F.length("a")) == F.min(F.length("a"))).alias("same_width"))
    open_ = M.best_moves(d).select("msa_id", F.lit(False).alias("open"))
    return d.join(width, "msa_id").join(open_, "msa_id", "left").select(
        "msa_id", "member", R.ungap("a").alias("residues"), "same_width", F.coalesce("open", F.lit(True)).alias("settled")
    )


@query("D4 D5 D16 D20 D21", f"""WITH {PAIR} SELECT msa_id, i, j, CAST(length(s1) AS BIGINT) AS used1, CAST(length(s2) AS BIGINT) AS used2, true AS same_score, true AS same_reversed FROM prs""")
def affine_path_consistency(t):
    """A path consumes both members, its rescored steps give the score, and the pair the other way round scores the same."""
    pairs = sequence_pairs(t)
    back = P.pair_scores(pairs.select("msa_id", "i", "j", F.col("s2").alias("s1"), F.col("s1").alias("s2")), KEYS).withColumnRenamed("score", "back")
    d = P.pair_alignments(pairs, KEYS)
    steps = F.transform(F.regexp_extract_all("cigar", F.lit("[0-9]+[MDI]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))
    used = lambda ops: F.aggregate(F.filter("steps", lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    d = d.withColumn("steps", steps).join(back, ["msa_id", "i", "j"]).join(P.rescored(pairs, d, KEYS), ["msa_id", "i", "j"])
    return d.select("msa_id", "i", "j", used("MD").alias("used1"), used("MI").alias("used2"), (F.abs(F.col("score") - F.col("again")) < 1e-6).alias("same_score"), (F.abs(F.col("score") - F.col("back")) < 1e-6).alias("same_reversed"))


@query("D6 T2", f"""WITH {PAIR} SELECT msa_id, i, j, true AS matches_best, true AS bounded FROM prs""")
def local_path_consistency(t):
    """The local path scores what the score-only pass says; global <= semi-global <= local."""
    pairs = sequence_pairs(t)
    score = {m: P.pair_scores(pairs, KEYS, mode=m).withColumnRenamed("score", m) for m in ("global", "semiglobal", "local")}
    d = P.pair_alignments(pairs, KEYS, mode="local")
    for s in score.values():
        d = d.join(s, ["msa_id", "i", "j"])
    return d.select("msa_id", "i", "j", (F.abs(F.col("score") - F.col("local")) < 1e-6).alias("matches_best"), ((F.col("global") <= F.col("semiglobal") + 1e-6) & (F.col("semiglobal") <= F.col("local") + 1e-6)).alias("bounded"))
