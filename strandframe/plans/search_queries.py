"""Database search, sparse graphs and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import residues as R
from strandframe.operators import chaining as C, pairwise as P, graphs as G, statistics as S, trees as T, word_join as J
from strandframe.plans.fragments import NT, QSEQ, SEQ, words
from strandframe.plans.registry import query
from strandframe.session import cut_lineage

SIM = f"""{SEQ}, {QSEQ}, {words('seq', 8)}, {words('qseq', 8, 'q_id', 'qwords')},
dw AS (SELECT seq_id, w, count(*) AS n FROM words GROUP BY ALL), dt AS (SELECT seq_id, sum(n) AS t FROM dw GROUP BY ALL),
qw AS (SELECT q_id, w, count(*) AS n FROM qwords GROUP BY ALL), qt AS (SELECT q_id, sum(n) AS t FROM qw GROUP BY ALL),
sh AS (SELECT q_id, seq_id, sum(least(dw.n, qw.n)) AS shared FROM dw JOIN qw USING (w) GROUP BY ALL),
sim AS (SELECT q_id, seq_id, CAST(shared AS BIGINT) AS shared, shared / least(dt.t, qt.t)::DOUBLE AS f FROM sh JOIN dt USING (seq_id) JOIN qt USING (q_id))"""


@query("J7 J9 J6 F8 P22 E1", f"WITH {SIM} SELECT q_id, seq_id, shared, round(f, 6) AS f FROM sim WHERE f >= 0.5")
def word_similarity_search(t):
    return J.similar_sequences(t.queries, t.seqs, 8, 0.5).withColumn("f", F.round("f", 6))


@query("J14 J15 J9 T8 T9", f"""WITH {SIM}, k AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY f DESC, seq_id) AS rk FROM sim WHERE f >= 0.4)
SELECT q_id, seq_id, shared, rk FROM k WHERE rk <= 5""")
def best_neighbours(t):
    d = J.similar_sequences(t.queries, t.seqs, 8, 0.4)
    top = S.top_per_group(d, ["q_id"], [F.desc("f"), "seq_id"], 5)
    return top.select("q_id", "seq_id", "shared", F.col("rk").cast("long").alias("rk"))


DIAG = f"""{SEQ}, {QSEQ}, {words('seq', 14)}, {words('qseq', 14, 'q_id', 'qwords')},
sd AS (SELECT q_id, seq_id, words.pos - qwords.pos AS diag, qwords.pos AS qp FROM words JOIN qwords USING (w)),
rn AS (SELECT *, qp - row_number() OVER (PARTITION BY q_id, seq_id, diag ORDER BY qp) AS run FROM sd),
mem AS (SELECT q_id, seq_id, min(qp) AS q_start, min(qp) + diag AS d_start, count(*) + 13 AS len FROM rn GROUP BY q_id, seq_id, diag, run)"""


@query("J10 J11 D24", f"WITH {DIAG} SELECT * FROM mem")
def diagonal_matches(t):
    return J.diagonal_matches(t.queries, t.seqs, 14)


CHAIN = f"""WITH RECURSIVE {DIAG}, ord AS (SELECT *, row_number() OVER (PARTITION BY q_id, seq_id ORDER BY q_start, d_start, len) AS i FROM mem),
arr AS (SELECT q_id, seq_id, list(q_start ORDER BY i) AS qs, list(d_start ORDER BY i) AS ds, list(len ORDER BY i) AS ln, count(*) AS n FROM ord GROUP BY ALL),
st AS (SELECT q_id, seq_id, 0::BIGINT AS i, []::BIGINT[] AS s, []::BIGINT[] AS c, []::BIGINT[] AS f FROM arr
 UNION ALL SELECT q_id, seq_id, i + 1, list_append(s, 10 * x + greatest(0, coalesce(best, 0))), list_append(c, 1 + CASE WHEN best > 0 THEN c[w0] ELSE 0 END), list_append(f, CASE WHEN best > 0 THEN f[w0] ELSE i + 1 END)
 FROM (SELECT *, list_max(g) AS best, list_position(g, list_max(g)) AS w0 FROM (
  SELECT st.*, ln[i + 1] AS x, list_transform(range(1, i + 1), lambda j: CASE WHEN qs[j] < qs[i + 1] AND ds[j] < ds[i + 1] AND qs[j] + ln[j] < qs[i + 1] + ln[i + 1] AND ds[j] + ln[j] < ds[i + 1] + ln[i + 1]
    AND 2 * greatest(0, qs[j] + ln[j] - qs[i + 1], ds[j] + ln[j] - ds[i + 1]) <= least(ln[j], ln[i + 1])
   THEN s[j] - 10 * greatest(0, qs[j] + ln[j] - qs[i + 1], ds[j] + ln[j] - ds[i + 1]) - CASE WHEN ds[j] - qs[j] = ds[i + 1] - qs[i + 1] THEN 0 ELSE 30 + abs(ds[j] - qs[j] - ds[i + 1] + qs[i + 1]) END ELSE -1 END) AS g
  FROM st JOIN arr USING (q_id, seq_id) WHERE i < n))),
fin AS (SELECT st.*, arr.*, list_max(s) AS top, list_position(s, list_max(s)) AS last FROM st JOIN arr USING (q_id, seq_id) WHERE i = n)"""


def chain_members(t):
    return C.chains(J.diagonal_matches(t.queries, t.seqs, 14))


@query("J12 T7", f"{CHAIN} SELECT q_id, seq_id, top / 10.0::DOUBLE AS score, c[last] AS hits FROM fin")
def chained_matches(t):
    """Best chain of the matches of a query and an entry, overlaps charged."""
    return chain_members(t).groupBy("q_id", "seq_id").agg(F.max("score").alias("score"), F.count("*").alias("hits"))


@query("D7 K10", f"""{CHAIN} SELECT q_id, seq_id, qs[f[last]] AS q_l, qs[last] + ln[last] - 1 AS q_r, ds[f[last]] AS d_l, ds[last] + ln[last] - 1 AS d_r,
qs[last] + ln[last] - qs[f[last]] AS used_q, ds[last] + ln[last] - ds[f[last]] AS used_d, true AS same_score FROM fin""")
def seeded_alignment(t):
    """Alignments cut at their chains: the path uses all of both sides, and its steps give the score again."""
    d = cut_lineage(C.seeded_alignments(cut_lineage(chain_members(t)), t.queries, t.seqs))  # both are read several times
    steps = F.transform(F.regexp_extract_all("cigar", F.lit("[0-9]+[MDI]"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "[0-9]+", 0).cast("long").alias("n"), F.substring(x, -1, 1).alias("op")))
    used = lambda ops: F.aggregate(F.filter("steps", lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    pairs = d.select("q_id", "seq_id", "s1", "s2")
    zero = F.lit(0).cast("long")
    again = P.rescored(pairs, d.withColumn("start1", zero).withColumn("start2", zero), "q_id long, seq_id long")
    d = d.withColumn("steps", steps).join(again, ["q_id", "seq_id"])
    return d.select("q_id", "seq_id", "q_l", "q_r", "d_l", "d_r", used("MD").alias("used_q"), used("MI").alias("used_d"), (F.abs(F.col("score") - F.col("again")) < 1e-6).alias("same_score"))


@query("T7", f"""WITH {DIAG}, best AS (SELECT *, row_number() OVER (PARTITION BY q_id, seq_id ORDER BY len DESC, q_start, d_start) AS rk FROM mem)
SELECT q_id, seq_id, q_start, d_start, len FROM best WHERE rk = 1""")
def best_local_match(t):
    d = J.diagonal_matches(t.queries, t.seqs, 14)
    best = F.max_by(F.struct("q_start", "d_start", "len"), F.struct("len", -F.col("q_start"), -F.col("d_start")))
    return d.groupBy("q_id", "seq_id").agg(best.alias("z")).select("q_id", "seq_id", "z.*")


@query("T2", f"""WITH RECURSIVE {DIAG}, st(kind, rk, q_id, seq_id, q_start, d_start, len) AS (
 SELECT 'r', 0::BIGINT, q_id, seq_id, q_start, d_start, len FROM mem
 UNION ALL (WITH cur AS (SELECT * FROM st WHERE kind = 'r' AND rk < 3), b AS (SELECT q_id, seq_id, max(rk) AS rk, arg_max(q_start, (len, -q_start, -d_start)) AS qs,
  arg_max(d_start, (len, -q_start, -d_start)) AS ds, max(len) AS ln FROM cur GROUP BY q_id, seq_id)
 SELECT 'h', rk + 1, q_id, seq_id, qs, ds, ln FROM b
 UNION ALL SELECT 'r', cur.rk + 1, cur.q_id, cur.seq_id, q_start, d_start, len FROM cur JOIN b ON b.q_id = cur.q_id AND b.seq_id = cur.seq_id
  WHERE (q_start + len <= qs OR qs + ln <= q_start) AND (d_start + len <= ds OR ds + ln <= d_start)))
SELECT q_id, seq_id, rk, q_start, d_start, len FROM st WHERE kind = 'h'""")
def local_matches_apart(t):
    return J.apart(J.diagonal_matches(t.queries, t.seqs, 14), 3)


@query("J13", f"""WITH {NT}, {QSEQ.replace("upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))", "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')")},
b AS (SELECT q_id, s, '+' AS strand FROM qseq UNION ALL SELECT q_id, reverse(translate(s, 'ACGT', 'TGCA')), '-' FROM qseq),
{words('nt', 8)}, {words('b', 8, 'q_id, strand', 'bw')}, dw AS (SELECT w, count(*) AS n FROM words GROUP BY w),
v AS (SELECT q_id, CAST(coalesce(sum(n) FILTER (strand = '+'), 0) AS BIGINT) AS forward, CAST(coalesce(sum(n) FILTER (strand = '-'), 0) AS BIGINT) AS reverse FROM bw JOIN dw USING (w) GROUP BY q_id)
SELECT q_id, forward, reverse, CASE WHEN forward >= reverse THEN '+' ELSE '-' END AS strand FROM v""")
def orientation_vote(t):
    q = t.queries.select("q_id", R.nucleotide("s").alias("s"))
    return J.orientation_vote(q, t.nts, 8)


EDGE = """ed AS (SELECT u, v, arg_min(value, (l_orderkey, l_linenumber, value)) AS dist FROM (SELECT 2 * l_partkey AS u, 2 * l_suppkey + 1 AS v, l_quantity AS value, l_orderkey, l_linenumber FROM lineitem
 WHERE l_quantity <= 2) GROUP BY u, v),
e2 AS (SELECT least(u, v) AS u, greatest(u, v) AS v, dist FROM ed)"""


def part_supplier_edges(t, threshold=2.0):
    rows = t.lineitem.select(
        (F.col("l_partkey") * 2).alias("u"), (F.col("l_suppkey") * 2 + 1).alias("v"), F.col("l_quantity").alias("value"), "l_orderkey", "l_linenumber"
    )
    return G.edge_list(rows, threshold, ["l_orderkey", "l_linenumber"])


@query("S16 G8 P22", f"WITH {EDGE} SELECT * FROM e2")
def edge_list_reader(t):
    return part_supplier_edges(t)


def comp_cte(edges: str, b: str, c: str) -> str:
    return f"""{b} AS (SELECT u, v FROM {edges} UNION ALL SELECT v, u FROM {edges}),
{c}(node, component) USING KEY (node) AS (SELECT u, min(u) FROM {b} GROUP BY u
 UNION SELECT {b}.u, min({c}.component) FROM {b} JOIN {c} ON {b}.v = {c}.node JOIN recurring.{c} AS r ON r.node = {b}.u WHERE {c}.component < r.component GROUP BY {b}.u)"""


COMP = f"WITH RECURSIVE {EDGE}, {comp_cte('e2', 'b', 'c')} SELECT * FROM c"
# A forest keeps size minus parts edges up to each weight; quantities up to the threshold are 1 and 2.
FOREST = f"""WITH RECURSIVE {EDGE}, {comp_cte('e2', 'b', 'c')}, e1 AS (SELECT * FROM e2 WHERE dist <= 1), {comp_cte('e1', 'b1', 'c1')},
k AS (SELECT c.component, count(*) AS size, count(DISTINCT coalesce(c1.component, c.node)) AS parts FROM c LEFT JOIN c1 ON c1.node = c.node GROUP BY c.component)
SELECT component, size, CASE WHEN parts > 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS height, CAST(size - parts + 2 * (parts - 1) AS DOUBLE) AS length FROM k"""
REPS = f"""WITH RECURSIVE {EDGE}, {comp_cte('e2', 'b', 'c')}, s AS (SELECT node, sum(dist) AS total FROM (SELECT u AS node, dist FROM e2 UNION ALL SELECT v, dist FROM e2) GROUP BY node),
nd AS (SELECT 2 * p_partkey AS node FROM part UNION ALL SELECT 2 * s_suppkey + 1 FROM supplier)
SELECT arg_min(node, (total, node)) AS node, component, count(*) AS members FROM c JOIN s USING (node) GROUP BY component
UNION ALL SELECT node, node, 1 FROM nd WHERE node NOT IN (SELECT node FROM c)"""


@query("E9 G7 E14", COMP)
def single_linkage_components(t):
    return G.components(part_supplier_edges(t))


@query("E9 T1 T4", FOREST)
def single_linkage_forest(t):
    forest = G.spanning_forest(part_supplier_edges(t))
    return G.forest_report(forest).orderBy(F.desc("size"), "component")


@query("J18 K18 G8", f"WITH {EDGE} SELECT 2 * p_partkey AS node FROM part WHERE 2 * p_partkey NOT IN (SELECT u FROM e2 UNION SELECT v FROM e2)")
def graph_outsiders(t):
    e = part_supplier_edges(t)
    linked = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node")))
    return t.part.select((F.col("p_partkey") * 2).alias("node")).join(linked, "node", "left_anti")


@query("G7", REPS)
def cluster_representatives(t):
    nodes = t.part.select((F.col("p_partkey") * 2).alias("node")).unionByName(t.supplier.select((F.col("s_suppkey") * 2 + 1).alias("node")))
    return G.representatives(part_supplier_edges(t), nodes)


@query("G7 J21", """WITH s AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)
SELECT min(doc_id) AS seq_id, count(*) AS copies FROM s GROUP BY s""")
def unique_sequences(t):
    """Identical sequences collapse to their first member; only digests and ids are shuffled."""
    d = t.seqs.select("seq_id", F.sha2("s", 256).alias("h"), F.length("s").alias("n"))
    return d.groupBy("h", "n").agg(F.min("seq_id").alias("seq_id"), F.count("*").alias("copies")).select("seq_id", "copies")


PROFILE = """pr AS (SELECT c_nationkey AS nk, o_orderpriority || '|' || CAST(month(o_orderdate) AS VARCHAR) AS w, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
tot AS (SELECT nk, sum(n) AS t FROM pr GROUP BY nk), sh AS (SELECT a.nk AS i, b.nk AS j, sum(least(a.n, b.n)) AS s FROM pr a JOIN pr b ON a.w = b.w AND a.nk < b.nk
 JOIN nation x ON x.n_nationkey = a.nk JOIN nation y ON y.n_nationkey = b.nk AND x.n_regionkey = y.n_regionkey GROUP BY ALL),
dm AS (SELECT x.n_regionkey AS grp, x.n_nationkey AS i, y.n_nationkey AS j, 1 - coalesce(s, 0) / coalesce(least(p.t, q.t), 1)::DOUBLE AS d FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey
 LEFT JOIN sh ON i = x.n_nationkey AND j = y.n_nationkey LEFT JOIN tot p ON p.nk = x.n_nationkey LEFT JOIN tot q ON q.nk = y.n_nationkey)"""


def nation_distances(t):
    """Word distances between order profiles of the nations of a region; nations are a fixed dimension."""
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("i"))
    word = F.concat("o_orderpriority", F.lit("|"), F.month("o_orderdate").cast("string"))
    prof = t.orders.select("o_custkey", word.alias("w")).join(cust, "o_custkey").groupBy("i", "w").agg(F.count("*").alias("n"))
    region = t.nation.select(F.col("n_nationkey").alias("i"), F.col("n_regionkey").alias("grp"))
    prof = prof.join(F.broadcast(region), "i")
    total = prof.groupBy("i").agg(F.sum("n").alias("t"))
    b = prof.select("grp", "w", F.col("i").alias("j"), F.col("n").alias("m"))
    shared = prof.join(b, ["grp", "w"]).filter("i < j").groupBy("grp", "i", "j").agg(F.sum(F.least("n", "m")).alias("s"))
    pairs = region.join(region.select("grp", F.col("i").alias("j")), "grp").filter("i < j")  # a fixed dimension
    d = pairs.join(shared, ["grp", "i", "j"], "left").join(total, "i", "left").join(total.select(F.col("i").alias("j"), F.col("t").alias("u")), "j", "left")
    least = F.when(F.col("t").isNull() | F.col("u").isNull(), 1).otherwise(F.least("t", "u")).cast("double")
    return d.select("grp", "i", "j", (1 - F.coalesce("s", F.lit(0)) / least).alias("d"))


def nation_leaves(t):
    return t.nation.select(F.col("n_regionkey").alias("grp"), F.col("n_nationkey").alias("node"))


@query("J1 J9 F8 E1 E16 J23", f"WITH {PROFILE} SELECT grp, i, j, round(d, 6) AS d FROM dm")
def distance_matrix(t):
    return nation_distances(t).withColumn("d", F.round("d", 6))


@query("K16", f"""WITH {PROFILE}, b AS (SELECT grp, i, j, d FROM dm UNION ALL SELECT grp, j, i, d FROM dm)
SELECT grp, i AS node, string_agg(CAST(j AS VARCHAR) || ':' || CAST(CAST(round(d * 1000000) AS BIGINT) AS VARCHAR), ' ' ORDER BY j) AS line FROM b GROUP BY grp, i""")
def distance_matrix_rows(t):
    d = T.both_ways(nation_distances(t))
    cell = F.array_sort(F.collect_list(F.struct("j", F.round(F.col("d") * 1000000).cast("long").alias("d"))))
    text = F.transform(cell, lambda x: F.concat_ws(":", x["j"].cast("string"), x["d"].cast("string")))
    return d.groupBy("grp", F.col("i").alias("node")).agg(F.array_join(text, " ").alias("line"))


# value of a merged pair and an outside cluster, from one row per side with its distance and size
_RULES = {
    "upgma": "sum(d * w) / sum(w)", "single": "min(d)", "complete": "max(d)", "mean": "avg(d)",
    "ward": "(sum((w + no) * d) - any_value(no) * any_value(dab)) / (sum(w) + any_value(no))",
}


def tree_sql(method: str, select: str) -> str:
    """Merges one pair per group and step: rows of kind e (distances), m (merges), l (leaf and its label) and c (leaf pairs when they meet)."""
    return f"""WITH RECURSIVE {PROFILE}, st(kind, grp, i, j, d, ni, nj) AS (
 SELECT 'e', grp, i, j, d, 1, 1 FROM dm
 UNION ALL SELECT 'l', n_regionkey, n_nationkey, n_nationkey, 0.0::DOUBLE, 1, 1 FROM nation
 UNION ALL (
 WITH e AS (SELECT * FROM st WHERE kind = 'e'), p AS (SELECT grp, arg_min(i, (d, i, j)) AS a, arg_min(j, (d, i, j)) AS b, min(d) AS dab, arg_min(ni, (d, i, j)) AS na, arg_min(nj, (d, i, j)) AS nb FROM e GROUP BY grp),
 x AS (SELECT e.grp, a, b, dab, na, nb, e.d, CASE WHEN i IN (a, b) THEN j ELSE i END AS o, CASE WHEN i IN (a, b) THEN nj ELSE ni END AS no, CASE WHEN i = a OR j = a THEN na ELSE nb END AS w,
  (i IN (a, b))::INT + (j IN (a, b))::INT AS k, i, j, ni, nj FROM e JOIN p ON e.grp = p.grp),
 f AS (SELECT grp, a, o, {_RULES[method]} AS d, any_value(na + nb) AS n, any_value(no) AS no FROM x WHERE k = 1 GROUP BY grp, a, o)
 SELECT 'e', grp, i, j, d, ni, nj FROM x WHERE k = 0
 UNION ALL SELECT 'e', grp, least(a, o), greatest(a, o), d, CASE WHEN a < o THEN n ELSE no END, CASE WHEN a < o THEN no ELSE n END FROM f
 UNION ALL SELECT 'm', grp, a, b, dab, na, nb FROM p
 UNION ALL SELECT 'c', x.grp, least(x.i, y.i), greatest(x.i, y.i), dab, 1, 1 FROM p JOIN st x ON x.kind = 'l' AND x.grp = p.grp AND x.j = a JOIN st y ON y.kind = 'l' AND y.grp = p.grp AND y.j = b
 UNION ALL SELECT 'l', s.grp, s.i, CASE WHEN s.j = b THEN a ELSE s.j END, 0.0, 1, 1 FROM st s JOIN p ON s.grp = p.grp WHERE s.kind = 'l'))
{select}"""


def first_leaf(node: str):
    """Label of a node: the smallest leaf under it (leaf keys are far below 2^32)."""
    return F.col(node) % F.lit(2**32)


def _tree(method):
    def build(t):
        d = T.linkage(nation_distances(t), nation_leaves(t), method)
        return d.select("grp", first_leaf("node").alias("first_leaf"), first_leaf("right").alias("second_leaf"), "ndesc", F.round("height", 6).alias("height"))

    build.__name__ = f"tree_{method}"
    return build


for _m in _RULES:
    query("E2 E18", tree_sql(_m, "SELECT grp, CAST(i AS BIGINT) AS first_leaf, CAST(j AS BIGINT) AS second_leaf, CAST(ni + nj AS BIGINT) AS ndesc, round(d / 2, 6) AS height FROM st WHERE kind = 'm'"))(_tree(_m))


@query("E3 E18", f"""WITH RECURSIVE {PROFILE}, st(kind, grp, step, i, j, d) AS (
 SELECT 'e', grp, 1::BIGINT, i::BIGINT, j::BIGINT, d FROM dm UNION ALL SELECT 'e', grp, 1, j, i, d FROM dm
 UNION ALL (
 WITH e AS (SELECT * FROM st WHERE kind = 'e'), r AS (SELECT grp, i, sum(d) AS r, count(*) + 1 AS m FROM e GROUP BY grp, i),
 q AS (SELECT e.*, x.r AS ri, y.r AS rj, x.m, round((x.m - 2) * d - x.r - y.r, 9) AS q FROM e JOIN r x ON x.grp = e.grp AND x.i = e.i JOIN r y ON y.grp = e.grp AND y.i = e.j WHERE e.i < e.j),
 p AS (SELECT *, i % 4294967296 + step * 4294967296 AS u, CASE WHEN m > 2 THEN greatest(0.0, least(d, d / 2 + (ri - rj) / (2 * (m - 2)))) ELSE d END AS li
  FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY q, i, j) AS k FROM q) WHERE k = 1),
 f AS (SELECT e.grp, p.u, e.j, (sum(e.d) - any_value(p.d)) / 2 AS d, any_value(p.step) + 1 AS step FROM e JOIN p ON p.grp = e.grp AND e.i IN (p.i, p.j) AND e.j NOT IN (p.i, p.j) GROUP BY e.grp, p.u, e.j)
 SELECT 'e', e.grp, e.step + 1, e.i, e.j, e.d FROM e JOIN p ON p.grp = e.grp AND e.i NOT IN (p.i, p.j) AND e.j NOT IN (p.i, p.j)
 UNION ALL SELECT 'e', grp, step, u, j, d FROM f UNION ALL SELECT 'e', grp, step, j, u, d FROM f
 UNION ALL SELECT 'b', grp, step, i, CASE WHEN m > 2 THEN u ELSE j END, li FROM p UNION ALL SELECT 'b', grp, step, j, u, d - li FROM p WHERE m > 2))
SELECT grp, i AS node, j AS parent, round(d, 6) AS length FROM st WHERE kind = 'b'""")
def tree_neighbour_joining(t):
    return T.neighbour_joining(nation_distances(t), nation_leaves(t)).withColumn("length", F.round("length", 6))


@query("E8", tree_sql("upgma", "SELECT grp, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(d, 6) AS dist FROM st WHERE kind = 'c'"))
def tree_cophenetic_distance(t):
    leaves = nation_leaves(t)
    d = T.cophenetic(T.linkage(nation_distances(t), leaves), leaves)
    return d.select("grp", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("dist", 6).alias("dist"))


@query("E5 K15")
def tree_member_weights(t):
    leaves = nation_leaves(t)
    return T.member_weights(T.linkage(nation_distances(t), leaves), leaves).withColumn("weight", F.round("weight", 6))


@query("E13", tree_sql("upgma", """SELECT n_regionkey AS grp, CAST(n_nationkey AS BIGINT) AS leaf, CAST(least(n_nationkey, coalesce(min(i), n_nationkey)) AS BIGINT) AS first_leaf
FROM nation LEFT JOIN st ON kind = 'c' AND grp = n_regionkey AND j = n_nationkey AND d / 2 <= 0.06 GROUP BY n_regionkey, n_nationkey"""))
def tree_cut(t):
    leaves = nation_leaves(t)
    d = T.cut_tree(T.linkage(nation_distances(t), leaves), leaves, 0.06)
    return d.select("grp", F.col("leaf").cast("long").alias("leaf"), first_leaf("cluster").alias("first_leaf"))
