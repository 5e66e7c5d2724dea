"""Interval sets from events (one per user and minute range) and statistics over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import intervals as I, statistics as S
from strandframe.plans.registry import query

DAY = 1440
IV = """iv AS (SELECT user_id, event_type, event_id, value, date_diff('minute', TIMESTAMP '2024-01-01', ts) AS l,
 date_diff('minute', TIMESTAMP '2024-01-01', ts) + 1 + CAST(floor(value) AS BIGINT) % 60 AS r FROM events)"""


def islands_sql(keys: str, src: str, name: str, near: int = 0) -> str:
    return f"""{name}_a AS (SELECT *, max(r) OVER (PARTITION BY {keys} ORDER BY l, r, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
{name}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR l > reach + {near} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY l, r, event_id ROWS UNBOUNDED PRECEDING) AS island FROM {name}_a),
{name} AS (SELECT {keys}, min(l) AS l, max(r) AS r FROM {name}_b GROUP BY {keys}, island)"""


def intervals(t):
    # minutes since 2024-01-01 00:00 UTC
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    minute = (day * 1440 + F.hour("ts") * 60 + F.minute("ts")).cast("long")
    return t.events.select(
        "user_id", "event_type", "event_id", "value", minute.alias("l"), (minute + 1 + F.floor("value") % 60).alias("r")
    )


@query("G2", f"WITH {IV}, {islands_sql('user_id', 'iv', 'u')} SELECT * FROM u")
def interval_union(t):
    return I.union(intervals(t), ["user_id"], DAY)


@query("W7 G2", f"WITH {IV}, {islands_sql('user_id', 'iv', 'u', 45)} SELECT * FROM u")
def interval_union_near(t):
    return I.union(intervals(t), ["user_id"], DAY, near=45)


@query("G3", f"""WITH {IV}, {islands_sql('user_id', 'iv', 'u')}, e AS (SELECT user_id, r AS l, lead(l) OVER (PARTITION BY user_id ORDER BY l) AS r FROM u
 UNION ALL SELECT user_id, 0, min(l) FROM u GROUP BY user_id UNION ALL SELECT user_id, max(r), 44640 FROM u GROUP BY user_id)
SELECT * FROM e WHERE r IS NOT NULL AND l < r""")
def interval_complement(t):
    return I.complement(intervals(t), ["user_id"], DAY, 0, 31 * DAY)


@query("G1 J16", f"""WITH {IV}, ca AS (SELECT * FROM iv WHERE event_type IN ('view', 'click')), cb AS (SELECT * FROM iv WHERE event_type NOT IN ('view', 'click')),
{islands_sql('user_id', 'ca', 'a')}, {islands_sql('user_id', 'cb', 'b')}
SELECT a.user_id, greatest(a.l, b.l) AS l, least(a.r, b.r) AS r FROM a JOIN b ON a.user_id = b.user_id AND a.l < b.r AND b.l < a.r""")
def interval_intersection(t):
    d = intervals(t)
    picked = F.col("event_type").isin("view", "click")
    return I.intersection(d.filter(picked), d.filter(~picked), ["user_id"], DAY)


@query("G4", f"WITH {IV}, {islands_sql('user_id', 'iv', 'u')} SELECT user_id, count(*) AS parts, CAST(sum(r - l) AS BIGINT) AS total FROM u GROUP BY user_id")
def interval_total_length(t):
    u = I.union(intervals(t), ["user_id"], DAY)
    return u.groupBy("user_id").agg(F.count("*").alias("parts"), F.sum(F.col("r") - F.col("l")).alias("total"))


@query("J16", f"""WITH {IV}, p AS (SELECT event_type, l AS p, 1 AS d FROM iv UNION ALL SELECT event_type, r, -1 FROM iv),
g AS (SELECT event_type, p, sum(d) AS d FROM p GROUP BY ALL), c AS (SELECT event_type, p AS l, lead(p) OVER w AS r, sum(d) OVER w AS depth FROM g
 WINDOW w AS (PARTITION BY event_type ORDER BY p)) SELECT event_type, l, r, CAST(depth AS BIGINT) AS depth FROM c WHERE depth > 0 AND r IS NOT NULL""")
def interval_coverage(t):
    return I.coverage(intervals(t), ["event_type"], DAY)


@query("J17 I10", f"""WITH {IV}, {islands_sql('user_id', 'iv', 'u')}, k AS (SELECT user_id, event_id, value,
 row_number() OVER (PARTITION BY user_id, island ORDER BY value DESC, event_id) AS rk, count(*) OVER (PARTITION BY user_id, island) AS members FROM u_b)
SELECT user_id, event_id, value, members FROM k WHERE rk = 1""")
def best_per_overlap_cluster(t):
    return I.best_per_cluster(intervals(t), ["user_id"], DAY, "value", "event_id")


@query("A29", "SELECT l_partkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd FROM lineitem GROUP BY l_partkey")
def mean_and_deviation(t):
    return t.lineitem.groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd")
    )


@query("A30", """SELECT CAST(CASE WHEN x < 6.5 THEN 0 WHEN x >= 12.5 THEN 25 ELSE floor((x - 6.5) / 0.25) + 1 END AS BIGINT) AS bin, count(*) AS n
FROM (SELECT ln(o_totalprice) AS x FROM orders WHERE o_totalprice > 0) GROUP BY ALL""")
def log_histogram(t):
    return S.histogram(t.orders.filter("o_totalprice > 0"), F.col("o_totalprice"), 6.5, 12.5, 24, F.log)


CRIT = "crit(m, thr) AS (VALUES " + ", ".join(f"({i + 3}, {x}::DOUBLE)" for i, x in enumerate(S.DIXON_05)) + ")"


def dixon_ctes(src: str, parity: bool = False) -> str:
    """``out(k, n, side, id, value, ratio)`` of one pass over ``src(k, id, v)``."""
    up8 = "0" if parity else "CASE WHEN hi1 > lo2 THEN (hi1 - hi2) / (hi1 - lo2) ELSE 0 END"
    den, num = ("hi1", "hi2") if parity else ("hi2", "hi3")
    return f"""x AS (SELECT k, id, v, row_number() OVER (PARTITION BY k ORDER BY v, id) AS a, row_number() OVER (PARTITION BY k ORDER BY v DESC, id) AS d FROM {src}),
e AS (SELECT k, count(*) AS n, max(v) FILTER (a=1) AS lo1, max(v) FILTER (a=2) AS lo2, max(v) FILTER (a=3) AS lo3,
 max(v) FILTER (d=1) AS hi1, max(v) FILTER (d=2) AS hi2, max(v) FILTER (d=3) AS hi3, max(id) FILTER (a=1) AS lo_id, max(id) FILTER (d=1) AS hi_id FROM x GROUP BY k),
t AS (SELECT *, CASE WHEN n <= 7 THEN CASE WHEN hi1 > lo1 THEN (lo2-lo1)/(hi1-lo1) ELSE 0 END WHEN n <= 10 THEN CASE WHEN hi2 > lo1 THEN (lo2-lo1)/(hi2-lo1) ELSE 0 END
  ELSE CASE WHEN {den} > lo1 THEN (lo3-lo1)/({den}-lo1) ELSE 0 END END AS low,
 CASE WHEN n <= 7 THEN CASE WHEN hi1 > lo1 THEN (hi1-hi2)/(hi1-lo1) ELSE 0 END WHEN n <= 10 THEN {up8}
  ELSE CASE WHEN hi1 > lo2 THEN (hi1-{num})/(hi1-lo2) ELSE 0 END END AS high FROM e JOIN crit ON m = least(n, 100) WHERE n > 2),
out AS (SELECT k, n, 'low' AS side, lo_id AS id, lo1 AS value, low AS ratio FROM t WHERE low >= thr UNION ALL SELECT k, n, 'high', hi_id, hi1, high FROM t WHERE high >= thr)"""


ORDERS = "src AS (SELECT o_custkey AS k, o_orderkey AS id, o_totalprice AS v FROM orders)"
OUT = "k AS o_custkey, n, side, id AS o_orderkey, value, round(ratio, 6) AS ratio"


def dixon_sql(parity: bool) -> str:
    return f"WITH {CRIT}, {ORDERS}, {dixon_ctes('src', parity)} SELECT {OUT} FROM out"


# kind r: rows still in the test, kind h: outliers found
DIXON_LOOP = f"""WITH RECURSIVE {CRIT}, {ORDERS}, st(kind, k, id, v, n, side, ratio) AS (
 SELECT 'r', k, id, v, 0::BIGINT, '', 0.0::DOUBLE FROM src
 UNION ALL (WITH cur AS (SELECT k, id, v FROM st WHERE kind = 'r'), {dixon_ctes('cur')}
 SELECT 'h', k, id, value, n, side, ratio FROM out
 UNION ALL SELECT 'r', c.k, c.id, c.v, 0, '', 0.0 FROM cur c WHERE c.k IN (SELECT k FROM out) AND NOT EXISTS (SELECT 1 FROM out o WHERE o.k = c.k AND o.id = c.id)))
SELECT k AS o_custkey, n, side, id AS o_orderkey, v AS value, round(ratio, 6) AS ratio FROM st WHERE kind = 'h'"""


@query("A31 A32", dixon_sql(False))
def dixon_outliers(t):
    return S.dixon(t.orders, ["o_custkey"], ["o_orderkey"], "o_totalprice").withColumn("ratio", F.round("ratio", 6))


@query("A31", dixon_sql(True))
def dixon_outliers_program_ratios(t):
    return S.dixon(t.orders, ["o_custkey"], ["o_orderkey"], "o_totalprice", parity=True).withColumn("ratio", F.round("ratio", 6))


@query("A31 A32", DIXON_LOOP)
def dixon_outliers_recursive(t):
    return S.dixon_recursive(t.orders, ["o_custkey"], ["o_orderkey"], "o_totalprice").withColumn("ratio", F.round("ratio", 6))


@query("T2 T9 J15 P21", """SELECT o_custkey, o_orderkey, o_totalprice, rk FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk
FROM orders WHERE o_totalprice >= 1000) WHERE rk <= 3""")
def top_hits_per_query(t):
    d = S.top_per_group(t.orders.filter("o_totalprice >= 1000"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3)
    return d.select("o_custkey", "o_orderkey", "o_totalprice", F.col("rk").cast("long").alias("rk"))


@query("T3 W15 T7", "SELECT l_suppkey, arg_max(l_partkey, (l_extendedprice, l_partkey)) AS l_partkey, max(l_extendedprice) AS best FROM lineitem GROUP BY l_suppkey")
def best_of_trials(t):
    return t.lineitem.groupBy("l_suppkey").agg(
        F.max_by("l_partkey", F.struct("l_extendedprice", "l_partkey")).alias("l_partkey"), F.max("l_extendedprice").alias("best")
    )


@query("P23", "SELECT o_orderkey, strftime(o_orderdate, '%d-') || upper(strftime(o_orderdate, '%b')) || strftime(o_orderdate, '-%Y') AS entry_date FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-15'")
def newer_than_date(t):
    """Entries whose DD-MON-YYYY date is not older than a given one (month names parsed back)."""
    d = t.orders.select("o_orderkey", F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("entry_date"))
    return d.filter(F.to_date(F.initcap(F.lower("entry_date")), "dd-MMM-yyyy") >= F.lit("1996-03-15").cast("date"))


@query("S25", """SELECT count(*) AS entries, CAST(sum(length(s)) AS BIGINT) AS area, CAST(min(length(s)) AS BIGINT) AS min_len, CAST(max(length(s)) AS BIGINT) AS max_len,
count(*) FILTER (length(s) = 0) AS empty, count(DISTINCT lang) AS kinds, CAST(max(CASE WHEN contains(text, '-') THEN 1 ELSE 0 END) AS BIGINT) AS has_gap
FROM (SELECT text, lang, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents)""")
def input_profile(t):
    from strandframe.functions import residues as R

    d = t.docs.select("lang", F.contains("text", F.lit("-")).alias("g"), F.length(R.letters("text")).cast("long").alias("n"))
    return d.agg(
        F.count("*").alias("entries"), F.sum("n").alias("area"), F.min("n").alias("min_len"), F.max("n").alias("max_len"),
        F.count(F.when(F.col("n") == 0, 1)).alias("empty"), F.countDistinct("lang").alias("kinds"), F.max(F.col("g").cast("long")).alias("has_gap"),
    )


@query("J19", """SELECT coalesce(h.doc_id, g.doc_id) AS doc_id, coalesce(g.quality, -1) AS quality, h.source,
CASE WHEN h.doc_id IS NULL THEN 'added' WHEN g.doc_id IS NULL THEN 'kept' ELSE 'replaced' END AS state
FROM documents h FULL JOIN (SELECT doc_id * 2 AS doc_id, quality FROM labels) g ON g.doc_id = h.doc_id""")
def upsert_members(t):
    host = t.documents.select(F.col("doc_id").alias("h"), "source")
    guest = t.labels.select((F.col("doc_id") * 2).alias("g"), "quality")
    state = F.when(F.col("h").isNull(), "added").when(F.col("g").isNull(), "kept").otherwise("replaced")
    return host.join(guest, F.col("h") == F.col("g"), "full").select(
        F.coalesce("h", "g").alias("doc_id"), F.coalesce("quality", F.lit(-1)).alias("quality"), "source", state.alias("state")
    )


@query("J18 K18", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def outsiders(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")
