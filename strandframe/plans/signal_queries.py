"""Queries of intron lengths and of paired splice signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import genes as G, signals as S
from strandframe.plans.fragments import NT
from strandframe.plans.gene_queries import INTR
from strandframe.plans.registry import query

ONE = S.Frechet(1.0, 10.0, 40.0, 2.0)
MIXED = [S.Frechet(0.7, 0.0, 1.5, 2.0), S.Frechet(0.3, 1.0, 6.0, 1.5)]
LEAST, MOST = 30, S.longest([ONE])
LONGEST = 40


def density_sql(x: str, c: S.Frechet) -> str:
    z = f"({c.th} / ({x} - {c.mu}))"
    return f"CASE WHEN {x} > {c.mu} THEN {c.k / c.th} * {z} * pow({z}, {c.k}) * exp(-pow({z}, {c.k})) ELSE 0 END"


_D = f"0.7 * {density_sql('n', MIXED[0])} + 0.3 * {density_sql('n', MIXED[1])}"
_AT = f"(SELECT {_D.replace('n >', f'{LONGEST} >').replace('(n -', f'({LONGEST} -')})"


@query("F11", f"""WITH {INTR}, w AS (SELECT id, intron_no, CAST(r - l AS BIGINT) AS n FROM intr WHERE r IS NOT NULL)
SELECT id, intron_no, n, CASE WHEN n > {LONGEST} THEN round(log10({_AT}) - {MIXED[1].k + 1} / ln(10) * (ln(n - 1) - ln({LONGEST} - 1)), 6) ELSE round(log10({_D}), 6) END AS penalty,
CAST(least(floor(CASE WHEN n > {MIXED[1].mu} THEN exp(-pow({MIXED[1].th} / (n - {MIXED[1].mu}), {MIXED[1].k})) ELSE 0 END * 100), 99) AS INTEGER) AS class FROM w""")
def intron_length_penalty(t):
    """Price of every intron's length and its quantile class."""
    d = G.introns(t.docs, "doc_id").select("id", F.col("intron_no").cast("long").alias("intron_no"), (F.col("r") - F.col("l")).cast("long").alias("n"))
    return d.select("id", "intron_no", "n", F.round(S.length_penalty(F.col("n"), MIXED, 1, LONGEST), 6).alias("penalty"), S.length_class(F.col("n"), MIXED[1]).alias("class"))


@query("W14 J16", f"""WITH {NT}, ps AS (SELECT seq_id, s, CAST(unnest(range(1, length(s))) AS BIGINT) AS p FROM nt WHERE length(s) > 1), pw AS (SELECT seq_id, p, substr(s, p, 2) AS w FROM ps),
dn AS (SELECT seq_id, p, CASE WHEN w = 'AT' THEN 2 ELSE 3 END AS lv FROM pw WHERE w IN ('GT', 'GC', 'AT')), ac AS (SELECT seq_id, p AS q, CASE WHEN w = 'AC' THEN 2 ELSE 3 END AS lv FROM pw WHERE w IN ('AG', 'AC')),
pr AS (SELECT seq_id, p, q, dn.lv, q + 2 - p AS n FROM dn JOIN ac USING (seq_id) WHERE dn.lv = ac.lv AND q BETWEEN p + {LEAST - 2} AND p + {MOST - 2}),
sc AS (SELECT *, round(2 * lv + log10({density_sql('n', ONE)}), 6) AS score FROM pr)
SELECT seq_id, p AS donor, arg_max(q, (score, -n)) AS acceptor, arg_max(n, (score, -n)) AS len, CAST(any_value(lv) AS BIGINT) AS level, max(score) AS score FROM sc GROUP BY seq_id, p""")
def splice_signal_pairs(t):
    """Best acceptor of every donor within the range of intron lengths."""
    return S.paired_signals(t.nts.select("seq_id", "s"), ONE, LEAST, MOST)
