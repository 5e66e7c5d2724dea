"""Reverse translation of columns, segments common to two alignments, paths between leaves."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from strandframe.functions import codons as C, residues as R
from strandframe.operators import alignment_columns as A, trees as T
from strandframe.plans.alignment_queries import DEPTH, PROF
from strandframe.plans.fragments import NT, ROWS, words
from strandframe.plans.registry import query
from strandframe.plans.residue_queries import CODE
from strandframe.plans.search_queries import nation_distances, nation_leaves, tree_sql


@query("P13", f"""WITH {NT}, {CODE}, {words('nt', 3)}, {PROF}, {DEPTH},
u AS (SELECT aa, codon, count(*) AS n FROM words JOIN gcode ON w = codon GROUP BY ALL), us AS (SELECT aa, codon, n / sum(n) OVER (PARTITION BY aa)::DOUBLE AS share FROM u),
b AS (SELECT msa_id, site, n * share AS w, CAST(unnest([1, 2, 3]) AS BIGINT) AS pos, unnest(string_split(codon, '')) AS base FROM prof JOIN us ON aa = r)
SELECT msa_id, site, pos, base, round(sum(w) / any_value(many), 6) AS freq FROM b JOIN dep USING (msa_id) GROUP BY msa_id, site, pos, base""")
def reverse_translation(t):
    """Columns of amino acids as base frequencies, by the codon usage of all documents."""
    n = t.nts.select(F.explode(R.kmers("s", 3)).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    n = n.withColumn("aa", C.translate("codon"))
    usage = n.select("aa", "codon", (F.col("n") / F.sum("n").over(W.partitionBy("aa")).cast("double")).alias("share"))  # 64 rows
    return A.reverse_translation(t.rows, usage).withColumn("freq", F.round("freq", 6))


@query("G6", f"""WITH {ROWS}, prs AS (SELECT x.msa_id, x.member AS i, y.member AS j, x.a AS a1, y.a AS a2 FROM rws x JOIN rws y ON x.msa_id = y.msa_id AND x.member % 2 = 0 AND y.member = x.member + 1),
u AS (SELECT msa_id, i, j, unnest(range(1, least(length(a1), length(a2)) + 1)) AS p, unnest(string_split(a1[1:least(length(a1), length(a2))], '')) AS x, unnest(string_split(a2[1:least(length(a1), length(a2))], '')) AS y
 FROM prs WHERE least(length(a1), length(a2)) > 0),
n AS (SELECT *, sum((x <> '-')::INT) OVER w AS num_i, sum((y <> '-')::INT) OVER w AS num_j FROM u WINDOW w AS (PARTITION BY msa_id, i ORDER BY p)),
c AS (SELECT msa_id, i, j, num_i, num_j, num_i - row_number() OVER (PARTITION BY msa_id, i, j ORDER BY num_i) AS run FROM n WHERE x <> '-' AND y <> '-' AND num_i = num_j)
SELECT msa_id, i, j, CAST(min(num_i) AS BIGINT) AS start_i, CAST(min(num_j) AS BIGINT) AS start_j, count(*) AS len FROM c GROUP BY msa_id, i, j, run""")
def common_alignment_segments(t):
    """The alignment of two rows as given against that of their ungapped sequences, residue for residue."""
    return A.shared_segments(A.consecutive_pairs(t.rows).withColumn("b1", R.ungap("a1")).withColumn("b2", R.ungap("a2")))


@query("E17", tree_sql("upgma", """, lev AS (SELECT grp, i AS x, d FROM st WHERE kind = 'c' UNION SELECT grp, j, d FROM st WHERE kind = 'c'),
c AS (SELECT grp, i, j, d FROM st WHERE kind = 'c')
SELECT c.grp, CAST(c.i AS BIGINT) AS i, CAST(c.j AS BIGINT) AS j, CAST((SELECT count(*) FROM lev WHERE lev.grp = c.grp AND lev.x = c.i AND lev.d <= c.d) + (SELECT count(*) FROM lev WHERE lev.grp = c.grp AND lev.x = c.j AND lev.d <= c.d) - 1 AS BIGINT) AS steps FROM c"""))
def tree_leaf_paths(t):
    leaves = nation_leaves(t)
    d = T.leaf_paths(T.linkage(nation_distances(t), leaves), leaves)
    return d.select("grp", *[F.col(c).cast("long").alias(c) for c in ("i", "j", "steps")])
