"""Aligned-row queries: every conversation is an alignment, every turn a member."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import divergence as D, residues as R, runs as U
from strandframe.operators import alignment_columns as A
from strandframe.plans.fragments import CELLS, ROWS
from strandframe.plans.registry import query

PROF = f"{CELLS}, prof AS (SELECT msa_id, site, r, count(*) AS n FROM cells WHERE r <> '-' GROUP BY ALL)"
DEPTH = "dep AS (SELECT msa_id, count(*) AS many, CAST(max(length(a)) AS BIGINT) AS width FROM rws GROUP BY msa_id)"
SITE = (
    f"{PROF}, {DEPTH}, site AS (SELECT msa_id, site, sum(n) AS res, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS eq, max(n) AS top, "
    "count(*) AS kinds, any_value(many) AS many FROM prof JOIN dep USING (msa_id) GROUP BY msa_id, site)"
)
PAIRS = {
    "consecutive": "SELECT x.msa_id, x.member AS i, y.member AS j, x.a AS a1, y.a AS a2 FROM rws x JOIN rws y ON x.msa_id = y.msa_id "
    "AND x.member % 2 = 0 AND y.member = x.member + 1",
    "first": "SELECT y.msa_id, x.member AS i, y.member AS j, x.a AS a1, y.a AS a2 FROM rws x JOIN rws y ON x.msa_id = y.msa_id "
    "AND x.member = 0 AND y.member > 0",
    "last": "SELECT y.msa_id, y.member AS i, x.member AS j, y.a AS a1, x.a AS a2 FROM rws x JOIN rws y ON x.msa_id = y.msa_id "
    "AND y.member < x.member WHERE x.member = (SELECT max(member) FROM rws z WHERE z.msa_id = x.msa_id)",
}


def pair_sql(kind: str, cols: str) -> str:
    """Pair statistics by windows: current gap run lengths of both sides, then conditional counts."""
    return f"""WITH {ROWS}, prs AS ({PAIRS[kind]}),
u AS (SELECT msa_id, i, j, unnest(range(1, greatest(length(a1), length(a2)) + 1)) AS p,
  unnest(string_split(rpad(a1, CAST(greatest(length(a1), length(a2)) AS INTEGER), '-'), '')) AS x,
  unnest(string_split(rpad(a2, CAST(greatest(length(a1), length(a2)) AS INTEGER), '-'), '')) AS y FROM prs),
k AS (SELECT *, x = '-' AS gx, y = '-' AS gy,
  max(CASE WHEN x <> '-' THEN p ELSE 0 END) OVER w AS lx, max(CASE WHEN y <> '-' THEN p ELSE 0 END) OVER w AS ly FROM u
  WINDOW w AS (PARTITION BY msa_id, i, j ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT *, sum(CASE WHEN gx AND gy THEN 1 ELSE 0 END) OVER (PARTITION BY msa_id, i, j ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dbl FROM k),
z AS (SELECT *, p - 1 - coalesce(lx, 0) AS ra,
  p - 1 - coalesce(ly, 0) - (coalesce(dbl, 0) - coalesce((SELECT 0), 0)) AS rb0 FROM b),
d AS (SELECT b1.*, CASE WHEN coalesce(ly, 0) = 0 THEN coalesce(dbl, 0) ELSE coalesce(dbl, 0) - first_value(coalesce(dbl, 0)) OVER
  (PARTITION BY msa_id, i, j, coalesce(ly, 0) ORDER BY p) END AS dsince FROM z b1),
e AS (SELECT *, p - 1 - coalesce(ly, 0) - dsince AS rb FROM d),
g AS (SELECT msa_id, i, j, count(*) FILTER (NOT gx AND NOT gy AND x = y) AS mch, count(*) FILTER (NOT gx AND NOT gy AND x <> y) AS mmc,
  count(*) FILTER (gx <> gy) AS unp, count(*) FILTER ((gx AND NOT gy AND ra <= rb) OR (gy AND NOT gx AND rb <= ra)) AS gap FROM e GROUP BY ALL)
SELECT {cols} FROM g"""


DIST = "CASE WHEN 0.8::DOUBLE*gap + (1-0.8::DOUBLE)*unp + mch + mmc > 0 THEN 1.0::DOUBLE - mch / (0.8::DOUBLE*gap + (1-0.8::DOUBLE)*unp + mch + mmc) ELSE 0 END"
DOD = "CASE WHEN mmc + 0.5::DOUBLE*gap + 0.5::DOUBLE*unp + mch > 0 THEN (mmc + 0.5::DOUBLE*gap + 0.5::DOUBLE*unp) / (mmc + 0.5::DOUBLE*gap + 0.5::DOUBLE*unp + mch) ELSE 0 END"


@query("A11 A13 J4", pair_sql("consecutive", f"msa_id, i, j, mch, mmc, unp, gap, round({DIST}, 6) AS dist, round({DOD}, 6) AS dod"))
def pair_statistics_consecutive(t):
    d = A.pair_statistics(A.consecutive_pairs(t.rows), "msa_id", "i", "j")
    return d.withColumn("dist", F.round("dist", 6)).withColumn("dod", F.round("dod", 6))


@query("A11 J2 P22", pair_sql("first", f"msa_id, j, mch, mmc, unp, gap, round({DIST}, 6) AS dist") + f" WHERE {DIST} < 0.95")
def pair_statistics_first_vs_others(t):
    d = A.pair_statistics(A.first_versus_others(t.rows), "msa_id", "j").filter("dist < 0.95")
    return d.withColumn("dist", F.round("dist", 6)).drop("dod")


@query("A11 J3", pair_sql("last", "msa_id, i, j, mch, mmc, unp, gap"))
def pair_statistics_others_vs_last(t):
    return A.pair_statistics(A.others_versus_last(t.rows), "msa_id", "i", "j").drop("dist", "dod")


P = "(mmc + 0.0::DOUBLE) / (mch + mmc)"
POLY = "(CASE WHEN p <= 0.7 THEN 1 - (0.987151::DOUBLE + 0.220560::DOUBLE * p) * p ELSE -1.260444::DOUBLE + (8.603930::DOUBLE - (13.869219::DOUBLE - 6.521836::DOUBLE * p) * p) * p END)"


@query("F6 F7 F9 F8", "SELECT msa_id, i, j, round(CASE WHEN p <= 0 THEN 0 WHEN 1 - p / 0.75 <= 0 THEN 1024 ELSE -0.75 * ln(1 - p / 0.75::DOUBLE) END, 6) AS jc_dna, "
       "round(CASE WHEN p <= 0 THEN 0 WHEN 1 - p / (19 / 20.0::DOUBLE) <= 0 THEN 1024 ELSE -19 / 20.0::DOUBLE * ln(1 - p / (19 / 20.0::DOUBLE)) END, 6) AS jc_protein, "
       f"round(CASE WHEN p <= 0 THEN 0 WHEN {POLY} > 0 THEN -100 * ln({POLY}) ELSE 1024 END, 6) AS pam, "
       f"CAST(CASE WHEN p >= 1 OR {POLY} <= 0 THEN 300 ELSE least(300, (CAST(floor(-100 * ln({POLY})) AS BIGINT) + 14) // 10 * 10) END AS BIGINT) AS pam_level, "
       "round(CASE WHEN p <= 0 THEN 0 WHEN 1 - p / 0.75 <= 0 THEN 1024 ELSE -75 * ln(1 - p / 0.75::DOUBLE) END, 6) AS pam_dna, "
       "round(-0.18704::DOUBLE * ln((0.00501::DOUBLE + 1 - p) / 1.00501::DOUBLE), 6) AS curve FROM ("
       + pair_sql("consecutive", f"msa_id, i, j, {P} AS p") + " WHERE mch + mmc > 0)")
def corrected_distances(t):
    d = A.pair_statistics(A.consecutive_pairs(t.rows), "msa_id", "i", "j").filter("mch + mmc > 0")
    p = (F.col("mmc") / (F.col("mch") + F.col("mmc")))
    return d.select(
        "msa_id", "i", "j", F.round(D.jukes_cantor(p, 4), 6).alias("jc_dna"), F.round(D.jukes_cantor(p, 20), 6).alias("jc_protein"),
        F.round(D.pam_correct(p), 6).alias("pam"), F.round(D.pam_correct(p, nucleotide=True), 6).alias("pam_dna"), D.pam_step(p).alias("pam_level"), F.round(D.word_distance(1 - p), 6).alias("curve"),
    )


@query("A19 A1", f"WITH {PROF} SELECT * FROM prof")
def site_profile(t):
    return A.profile(t.cells)


@query("A35 F19", f"""WITH {SITE} SELECT msa_id, site, CAST(res AS BIGINT) AS res, CAST(many - res AS BIGINT) AS gaps, top,
CASE WHEN kinds = 1 AND res = many AND many > 1 THEN '*' WHEN top * 2 > many THEN '.' ELSE ' ' END AS mark FROM site""")
def column_statistics(t):
    s = A.site_counts(t.cells, t.rows)
    mark = F.when((F.col("kinds") == 1) & (F.col("res") == F.col("many")) & (F.col("many") > 1), "*").when(F.col("top") * 2 > F.col("many"), ".").otherwise(" ")
    return s.select("msa_id", "site", "res", (F.col("many") - F.col("res")).alias("gaps"), "top", mark.alias("mark"))


@query("A17 A18", f"""WITH {SITE} SELECT msa_id, CAST(sum(eq * 2 - (res * (res - 1) // 2 - eq) - 2 * res * (many - res)) AS BIGINT) AS sp FROM site GROUP BY msa_id""")
def sum_of_pairs_score(t):
    return A.sum_of_pairs(t.cells, t.rows)


@query("A17", f"""WITH {CELLS}, m AS (SELECT x.msa_id, x.site, sum(CASE WHEN x.r = y.r THEN 2 ELSE -1 END) AS s
FROM cells x JOIN cells y ON x.msa_id = y.msa_id AND x.site = y.site AND x.member < y.member WHERE x.r <> '-' AND y.r <> '-' GROUP BY ALL)
SELECT msa_id, CAST(sum(s) AS BIGINT) AS sp_residues FROM m GROUP BY msa_id""")
def sum_of_pairs_against_pairs(t):
    """The closed form against SQL that enumerates the pairs."""
    s = A.site_counts(t.cells, t.rows).filter("res > 1")
    return s.groupBy("msa_id").agg(F.sum(A.pair_score(2, -1, 0)).alias("sp_residues"))


@query("A17 A36 P5", f"""WITH {CELLS}, wt AS (SELECT msa_id, member, CAST(length(replace(a, '-', '')) % 7 + 1 AS BIGINT) AS w FROM rws),
g AS (SELECT msa_id, site, r, sum(w) AS w, sum(w * w) AS w2 FROM cells JOIN wt USING (msa_id, member) WHERE r <> '-' GROUP BY ALL)
SELECT msa_id, CAST(sum((w * w - w2) // 2) AS BIGINT) AS weighted_identity FROM g GROUP BY msa_id""")
def weighted_pair_identity(t):
    w = (F.length(R.ungap("a")) % 7 + 1).cast("long")
    return A.weighted_identity(t.rows.select("msa_id", w.alias("w"), "a"))


@query("A12", f"""WITH {CELLS}, g AS (SELECT msa_id, site, r, count(*) FILTER (role = 'user') AS n1, count(*) FILTER (role <> 'user') AS n2
FROM cells WHERE r <> '-' GROUP BY ALL), s AS (SELECT msa_id, site, sum(n1 * n2) AS mch, sum(n1) AS a, sum(n2) AS b FROM g GROUP BY ALL)
SELECT msa_id, CAST(sum(mch) AS BIGINT) AS mch, CAST(sum(a * b - mch) AS BIGINT) AS mmc FROM s GROUP BY msa_id""")
def group_against_group(t):
    user = F.when(F.col("role") == "user", 1).otherwise(0)
    g = t.cells.filter("r != '-'").groupBy("msa_id", "site", "r").agg(F.sum(user).alias("n1"), F.sum(1 - user).alias("n2"))
    s = g.groupBy("msa_id", "site").agg(F.sum(F.col("n1") * F.col("n2")).alias("mch"), F.sum("n1").alias("a"), F.sum("n2").alias("b"))
    return s.groupBy("msa_id").agg(F.sum("mch").alias("mch"), F.sum(F.col("a") * F.col("b") - F.col("mch")).alias("mmc"))


@query("A20", f"""WITH {PROF}, {DEPTH}, k AS (SELECT *, row_number() OVER (PARTITION BY msa_id, site ORDER BY n DESC, r) AS rk FROM prof),
s AS (SELECT msa_id, CAST(unnest(range(1, width + 1)) AS BIGINT) AS site FROM dep)
SELECT s.msa_id, string_agg(coalesce(r, 'X'), '' ORDER BY s.site) AS consensus FROM s LEFT JOIN k ON k.msa_id = s.msa_id AND k.site = s.site AND rk = 1 GROUP BY s.msa_id""")
def consensus_rows(t):
    return A.consensus(t.cells, t.rows)


@query("P7 G9 A35", f"""WITH {SITE}, k AS (SELECT msa_id, site FROM site WHERE many - res < 0.5 * many)
SELECT msa_id, site, row_number() OVER (PARTITION BY msa_id ORDER BY site) AS new_site FROM k""")
def drop_gappy_columns(t):
    return A.kept_sites(t.cells, t.rows, 0.5)


@query("A2 A3 A36", f"""WITH {ROWS}, {DEPTH} SELECT msa_id, member, CAST(length(a) - length(replace(a, '-', '')) AS BIGINT) AS gaps,
CAST(width - length(a) AS BIGINT) AS end_gaps, CAST(length(replace(a, '-', '')) AS BIGINT) AS residues,
CAST(length(replace(a, '-', '')) AS DOUBLE) / width AS weight FROM rws JOIN dep USING (msa_id)""")
def member_gap_counts(t):
    d = t.rows.join(A.depth(t.rows), "msa_id")
    n = F.length(R.ungap("a"))
    return d.select(
        "msa_id", "member", R.count_in("a", "-").cast("long").alias("gaps"), (F.col("width") - F.length("a")).alias("end_gaps"),
        n.cast("long").alias("residues"), (n.cast("double") / F.col("width")).alias("weight"),
    )


RUNS_SQL = """g AS (SELECT msa_id, member, site, site - row_number() OVER (PARTITION BY msa_id, member ORDER BY site) AS k FROM cells WHERE r = '-'),
gr AS (SELECT msa_id, member, min(site) - 1 AS gps, count(*) AS gln FROM g GROUP BY msa_id, member, k)"""


@query("W2 S31 G9 D16", f"WITH {CELLS}, {RUNS_SQL} SELECT msa_id, member, CAST(gps AS INTEGER) AS gps, CAST(gln AS INTEGER) AS gln FROM gr")
def gap_run_list(t):
    return A.gap_runs(t.rows)


@query("A21", f"""WITH {CELLS}, {RUNS_SQL}, e AS (SELECT msa_id, gps, unnest(range(1, gln + 1)) AS gaplen FROM gr)
SELECT msa_id, gps + gaplen AS site, gaplen, count(*) AS n FROM e GROUP BY ALL""")
def gap_length_profile(t):
    return A.gap_states(t.rows)


@query("A23", f"""WITH {CELLS}, {RUNS_SQL}, e AS (SELECT msa_id, gps, unnest(range(1, gln + 1)) AS gaplen FROM gr),
s AS (SELECT msa_id, gps + gaplen AS site, count(DISTINCT gaplen) AS k FROM e GROUP BY ALL), {DEPTH}
SELECT d.msa_id, round(1 + coalesce(sum(k), 0) / d.width::DOUBLE, 6) AS heterogeneity FROM dep d LEFT JOIN s ON s.msa_id = d.msa_id GROUP BY d.msa_id, d.width""")
def mean_gap_heterogeneity(t):
    per = A.gap_states(t.rows).groupBy("msa_id").agg(F.count("*").alias("k"))
    d = A.depth(t.rows).join(per, "msa_id", "left")
    return d.select("msa_id", F.round(1 + F.coalesce("k", F.lit(0)) / F.col("width").cast("double"), 6).alias("heterogeneity"))


@query("A24", f"""WITH {CELLS}, l AS (SELECT msa_id, site, r, lag(r) OVER (PARTITION BY msa_id, member ORDER BY site) AS q FROM cells)
SELECT msa_id, site, count(*) FILTER (r <> '-') AS density, count(*) FILTER (r <> '-' AND q IS NOT NULL AND q <> '-') AS di_density FROM l
GROUP BY msa_id, site HAVING count(*) FILTER (r <> '-') > 0""")
def column_density(t):
    chars = F.split("a", "")
    both = F.zip_with(chars, F.concat(F.array(F.lit("-")), chars), lambda x, q: F.struct((x != "-").alias("d"), ((x != "-") & (q != "-")).alias("dd")))
    d = t.rows.select("msa_id", F.posexplode(both).alias("p", "v")).filter("v.d")
    return d.groupBy("msa_id", (F.col("p") + 1).cast("long").alias("site")).agg(
        F.count("*").alias("density"), F.sum(F.col("v.dd").cast("long")).alias("di_density")
    )


@query("A14 A15 E1", f"""WITH {CELLS}, p AS (SELECT x.msa_id, x.member, count(*) FILTER (x.r <> y.r) AS mismatches, count(*) AS shared
FROM cells x JOIN cells y ON x.msa_id = y.msa_id AND x.site = y.site AND x.member <> y.member WHERE x.r <> '-' AND y.r <> '-' GROUP BY ALL)
SELECT msa_id, member, mismatches, shared FROM p""")
def member_distance_sums(t):
    """Distance sums from the profile against SQL that enumerates the pairs."""
    return A.member_distance_sums(t.rows).filter("shared > 0")


@query("A34 P9", f"""WITH {PROF}, {DEPTH}, f AS (SELECT msa_id, site, r, n, many FROM prof JOIN dep USING (msa_id)
 UNION ALL SELECT msa_id, site, '-', many - sum(n), many FROM prof JOIN dep USING (msa_id) GROUP BY msa_id, site, many HAVING many > sum(n)),
b AS (SELECT *, n * 3 // many AS base, n * 3 % many AS rem FROM f),
k AS (SELECT *, 3 - sum(base) OVER (PARTITION BY msa_id, site) AS lft, row_number() OVER (PARTITION BY msa_id, site ORDER BY rem DESC, r) AS rk FROM b)
SELECT msa_id, site, string_agg(repeat(r, CAST(base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS INTEGER)), '' ORDER BY r) AS "column" FROM k GROUP BY ALL""")
def representative_reduction(t):
    return A.apportion(t.rows, 3)


@query("W1 P25 P28", f"""WITH {CELLS} SELECT msa_id, member, CAST(row_number() OVER (PARTITION BY msa_id, member ORDER BY site) AS BIGINT) AS num, site
FROM cells WHERE r <> '-'""")
def residue_numbering(t):
    d = t.rows.select("msa_id", "member", F.posexplode(U.residue_sites("a")).alias("p", "site"))
    return d.select("msa_id", "member", (F.col("p") + 1).cast("long").alias("num"), F.col("site").cast("long").alias("site"))


@query("P28 J4", f"""WITH {ROWS}, prs AS (SELECT x.msa_id, x.member AS i, y.member AS j, x.a AS a1, y.a AS a2 FROM rws x JOIN rws y ON x.msa_id = y.msa_id AND x.member % 2 = 0 AND y.member = x.member + 1),
u AS (SELECT msa_id, i, j, unnest(range(1, least(length(a1), length(a2)) + 1)) AS p, unnest(string_split(a1[1:least(length(a1), length(a2))], '')) AS x, unnest(string_split(a2[1:least(length(a1), length(a2))], '')) AS y
 FROM prs WHERE least(length(a1), length(a2)) > 0),
n AS (SELECT *, sum((x <> '-')::INT) OVER w AS num_i, sum((y <> '-')::INT) OVER w AS num_j FROM u WINDOW w AS (PARTITION BY msa_id, i ORDER BY p))
SELECT msa_id, i, j, CAST(num_i AS BIGINT) AS num_i, CAST(num_j AS BIGINT) AS num_j FROM n WHERE x <> '-' AND y <> '-'""")
def map_residues_between_members(t):
    """Rows are joined, not cells; residues are numbered in kernels on the pairs."""
    return A.residue_maps(A.consecutive_pairs(t.rows))


@query("P26 P29", f"""WITH {CELLS}, g AS (SELECT msa_id, member, min(site) AS first_site, max(site) AS last_site FROM cells WHERE r <> '-' GROUP BY ALL)
SELECT rws.msa_id, rws.member, first_site, last_site, repeat('~', CAST(first_site - 1 AS INTEGER)) || substr(a, first_site, last_site - first_site + 1)
 || repeat('~', CAST(length(a) - last_site AS INTEGER)) AS marked FROM rws JOIN g ON rws.msa_id = g.msa_id AND rws.member = g.member""")
def end_gap_marking(t):
    core = F.regexp_replace("a", "^-+|-+$", "")
    first = F.length(F.regexp_extract("a", "^-*", 0)) + 1
    last = first + F.length(core) - 1
    d = t.rows.filter(F.translate("a", "-", "") != "")
    return d.select(
        "msa_id", "member", first.cast("long").alias("first_site"), last.cast("long").alias("last_site"),
        F.concat(F.repeat(F.lit("~"), first - 1), core, F.repeat(F.lit("~"), F.length("a") - last)).alias("marked"),
    )


@query("P19 G10", f"""WITH {ROWS}, {DEPTH} SELECT msa_id, member, lpad(replace(a, '-', ''), CAST(width AS INTEGER), '-') AS right_,
rpad(replace(a, '-', ''), CAST(width AS INTEGER), '-') AS left_,
rpad(lpad(replace(a, '-', ''), CAST(length(replace(a, '-', '')) + (width - length(replace(a, '-', ''))) // 2 AS INTEGER), '-'), CAST(width AS INTEGER), '-') AS centre_
FROM rws JOIN dep USING (msa_id)""")
def justify_rows(t):
    d = t.rows.join(A.depth(t.rows), "msa_id").withColumn("u", R.ungap("a")).withColumn("width", F.col("width").cast("int"))
    half = F.length("u") + F.floor((F.col("width") - F.length("u")) / 2).cast("int")
    return d.select(
        "msa_id", "member", F.lpad("u", F.col("width"), "-").alias("right_"), F.rpad("u", F.col("width"), "-").alias("left_"),
        F.rpad(F.lpad("u", half, "-"), F.col("width"), "-").alias("centre_"),
    )


@query("P3 P4 P20", f"""WITH {ROWS} SELECT msa_id, member, substr(a, 11, 30) || substr(a, 61, 20) AS spliced, replace(a, '-', '') AS ungapped FROM rws""")
def slice_and_append_columns(t):
    return t.rows.select("msa_id", "member", F.concat(F.substring("a", 11, 30), F.substring("a", 61, 20)).alias("spliced"), R.ungap("a").alias("ungapped"))


@query("P5 P18", f"""WITH {ROWS}, k AS (SELECT msa_id, member, CAST(length(replace(a, '-', '')) AS BIGINT) AS w FROM rws WHERE role = 'user')
SELECT msa_id, member, round(w / sum(w) OVER (PARTITION BY msa_id)::DOUBLE, 9) AS weight FROM k""")
def select_members_reweighted(t):
    d = t.rows.filter("role = 'user'").select("msa_id", "member", F.length(R.ungap("a")).alias("w"))
    total = d.groupBy("msa_id").agg(F.sum("w").alias("total"))
    return d.join(total, "msa_id").select("msa_id", "member", F.round(F.col("w") / F.col("total").cast("double"), 9).alias("weight"))


@query("P18 J20", f"""WITH {ROWS}, nm AS (SELECT DISTINCT 'c' || (doc_id % 97) || ':' || (doc_id % 5) AS name FROM labels)
SELECT msa_id, member, CASE WHEN nm.name IS NULL THEN 'kept' ELSE 'chosen' END AS state FROM rws LEFT JOIN nm ON nm.name = 'c' || msa_id || ':' || member""")
def choose_members_by_name(t):
    names = t.labels.select(
        F.concat(F.lit("c"), (F.col("doc_id") % 97).cast("string"), F.lit(":"), (F.col("doc_id") % 5).cast("string")).alias("name")
    ).distinct().withColumn("state", F.lit("chosen"))
    d = t.rows.select("msa_id", "member", F.concat(F.lit("c"), F.col("msa_id").cast("string"), F.lit(":"), F.col("member").cast("string")).alias("name"))
    return d.join(names, "name", "left").select("msa_id", "member", F.coalesce("state", F.lit("kept")).alias("state"))


@query("J21", f"""WITH {ROWS} SELECT rws.msa_id, rws.member, CASE WHEN replace(a, '-', '') = upper(regexp_replace(c.text, '[^A-Za-z]', '', 'g')) THEN 'OK' ELSE 'differs' END AS verdict
FROM rws JOIN conversations c ON c.conv_id = rws.msa_id AND c.turn = rws.member""")
def alignment_consistency(t):
    source = t.conversations.select(F.col("conv_id").alias("msa_id"), F.col("turn").alias("member"), R.letters("text").alias("u"))
    return t.rows.join(source, ["msa_id", "member"]).select(
        "msa_id", "member", F.when(R.ungap("a") == F.col("u"), "OK").otherwise("differs").alias("verdict")
    )


@query("A16 J8", f"""WITH {PROF.replace('count(*) AS n', 'count(*) AS n')}, {ROWS.replace('rws', 'r2')}
SELECT msa_id, member, CAST(2 * length(replace(a, '-', '')) AS BIGINT) AS self_score FROM r2""")
def self_scores(t):
    return t.rows.select("msa_id", "member", (F.length(R.ungap("a")) * 2).cast("long").alias("self_score"))


SEG_SQL = f"""WITH RECURSIVE {SITE}, sc AS (SELECT msa_id, site, CAST(CASE WHEN top * 2 > many THEN 3 ELSE -1 END AS BIGINT) AS v FROM site),
o AS (SELECT msa_id, site, v, row_number() OVER (PARTITION BY msa_id ORDER BY site) AS i, count(*) OVER (PARTITION BY msa_id) AS n FROM sc),
st AS (SELECT msa_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS mx, CAST(0 AS BIGINT) AS l, CAST(0 AS BIGINT) AS r, false AS closed,
  CAST(0 AS BIGINT) AS ol, CAST(0 AS BIGINT) AS orr, CAST(0 AS BIGINT) AS os FROM (SELECT DISTINCT msa_id FROM o)
 UNION ALL
 SELECT msa_id, i, CASE WHEN closed THEN 0 ELSE s END, CASE WHEN closed THEN 0 ELSE mx END, l, r, closed, l, r, mx FROM (
  SELECT *, mx > 0 AND (s <= 0 OR s < mx - 12 OR i = n) AS closed FROM (
   SELECT st.msa_id, o.i, o.n, greatest(0, st.s + v) AS s, CASE WHEN st.s + v >= 12 AND st.s + v > st.mx THEN st.s + v ELSE st.mx END AS mx,
    CASE WHEN st.s = 0 AND v > 0 THEN o.site ELSE st.l END AS l, CASE WHEN st.s + v >= 12 AND st.s + v > st.mx THEN o.site ELSE st.r END AS r
   FROM st JOIN o ON o.msa_id = st.msa_id AND o.i = st.i + 1)))
SELECT msa_id, ol AS l, orr AS r, os AS score FROM st WHERE closed"""


@query("W4", SEG_SQL)
def conserved_segments(t):
    s = A.site_counts(t.cells, t.rows)
    score = F.when(F.col("top") * 2 > F.col("many"), 3).otherwise(-1).cast("long")
    return A.scoring_segments(s.select("msa_id", "site", score.alias("score")), 12)
