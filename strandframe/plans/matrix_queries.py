"""Query of substitution scores from the letters of consecutive turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import alignment_columns as A, mutation as M
from strandframe.plans.fragments import CELLS
from strandframe.plans.registry import query

DOUBLINGS = 6
POWERS = ", ".join(f"m{k} AS (SELECT a.old, b.new, sum(a.p * b.p) AS p, any_value(b.f) AS f FROM m{k - 1} a JOIN m{k - 1} b ON a.new = b.old GROUP BY a.old, b.new)" for k in range(1, DOUBLINGS + 1))
ODDS = f"""WITH {CELLS}, pr AS (SELECT x.r AS x, y.r AS y FROM cells x JOIN cells y ON x.msa_id = y.msa_id AND x.member % 2 = 0 AND y.member = x.member + 1 AND x.site = y.site WHERE x.r <> '-' AND y.r <> '-'),
n AS (SELECT x, y, count(*) AS n FROM (SELECT x, y FROM pr UNION ALL SELECT y, x FROM pr) GROUP BY x, y),
s AS (SELECT x, sum(n) AS nx, coalesce(sum(n) FILTER (x <> y), 0) AS moved FROM n GROUP BY x), w AS (SELECT sum(nx) AS whole, sum(moved) AS all_moved FROM s),
m0 AS (SELECT a.x AS old, b.x AS new, CASE WHEN a.x = b.x THEN 1 - 0.01 * whole / all_moved * a.moved / a.nx ELSE 0.01 * whole / all_moved * coalesce(n.n, 0) / a.nx END::DOUBLE AS p, (b.nx / whole)::DOUBLE AS f FROM s a, s b, w LEFT JOIN n ON n.x = a.x AND n.y = b.x), {POWERS}
SELECT old, new, round(p, 8) AS p, round(10 * log10(p / f), 4) AS score FROM m{DOUBLINGS}"""


@query("F14 F15", ODDS)
def substitution_log_odds(t):
    """Scores of letter pairs after 64 steps of the mutation matrix that consecutive turns give."""
    d = M.log_odds(M.pair_counts(A.consecutive_pairs(t.rows)), DOUBLINGS)
    return d.select("old", "new", F.round("p", 8).alias("p"), F.round("score", 4).alias("score"))
