"""Queries over rooted trees: parsimony, weights, rooting, division, pruning and texts, with recursive SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import rooted as B, trees as T
from strandframe.plans.registry import QUERIES, query
from strandframe.plans.search_queries import nation_distances, nation_leaves, tree_sql

#: A node's name in both engines: its smallest leaf and its number of leaves.
NAME = 1000
# branches of the dendrograms of nations, from the merges of ``tree_sql``
BRANCH = f""", mg AS (SELECT grp, i, j, d / 2 AS h, ni, nj FROM st WHERE kind = 'm'),
ht AS (SELECT grp, CAST(i * {NAME} + ni + nj AS BIGINT) AS node, h, ni + nj AS ndesc FROM mg UNION ALL SELECT n_regionkey, CAST(n_nationkey * {NAME} + 1 AS BIGINT), 0.0, 1 FROM nation),
ch AS (SELECT grp, CAST(i * {NAME} + ni AS BIGINT) AS node, CAST(i * {NAME} + ni + nj AS BIGINT) AS parent FROM mg UNION ALL SELECT grp, CAST(j * {NAME} + nj AS BIGINT), CAST(i * {NAME} + ni + nj AS BIGINT) FROM mg),
br AS (SELECT ht.grp, ht.node, ch.parent, p.h - ht.h AS length, ht.h, ht.ndesc FROM ht LEFT JOIN ch ON ch.grp = ht.grp AND ch.node = ht.node LEFT JOIN ht p ON p.grp = ht.grp AND p.node = ch.parent),
anc AS (SELECT grp, node, node AS a, 0 AS k FROM br UNION ALL SELECT anc.grp, anc.node, br.parent, k + 1 FROM anc JOIN br ON br.grp = anc.grp AND br.node = anc.a WHERE br.parent IS NOT NULL)"""


def dendrogram(t, method: str = "upgma"):
    """Dendrograms of nations by region with nodes named as in the SQL."""
    leaves = nation_leaves(t)
    d = T.linkage(nation_distances(t), leaves, method)
    size = d.select("grp", "node", "ndesc").unionByName(leaves.select("grp", F.col("node").cast("long").alias("node"), F.lit(1).cast("long").alias("ndesc")))
    name = (F.col("node") % F.lit(2**32)) * NAME + F.col("ndesc")
    named = lambda c: size.select("grp", F.col("node").alias(c), name.alias(f"new_{c}"))
    for c in ("node", "left", "right"):
        d = d.join(named(c), ["grp", c]).drop(c).withColumnRenamed(f"new_{c}", c)
    return B.cut_lineage(d), leaves.select("grp", (F.col("node").cast("long") * NAME + 1).alias("node"))


# a nation's site is a day on which it ordered, as an intron of a gene is a place that a member has
DOLLO = tree_sql("upgma", BRANCH + """, pres AS (SELECT DISTINCT n_regionkey AS grp, c_nationkey * 1000 + 1 AS node, CAST(o_orderdate AS DATE) AS site FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey),
has AS (SELECT DISTINCT pres.grp, anc.a AS node, site FROM pres JOIN anc ON anc.grp = pres.grp AND anc.node = pres.node),
carriers AS (SELECT grp, site, count(*) AS n FROM pres GROUP BY grp, site),
cov AS (SELECT pres.grp, anc.a AS node, site, count(*) AS n FROM pres JOIN anc ON anc.grp = pres.grp AND anc.node = pres.node GROUP BY ALL),
born AS (SELECT cov.grp, site, arg_min(cov.node, ndesc) AS node FROM cov JOIN carriers USING (grp, site, n) JOIN br ON br.grp = cov.grp AND br.node = cov.node GROUP BY cov.grp, site),
lost AS (SELECT br.grp, br.node, up.site FROM br JOIN has up ON up.grp = br.grp AND up.node = br.parent JOIN born ON born.grp = br.grp AND born.site = up.site
 JOIN anc ON anc.grp = br.grp AND anc.node = br.parent AND anc.a = born.node LEFT JOIN has me ON me.grp = br.grp AND me.node = br.node AND me.site = up.site WHERE me.node IS NULL),
g AS (SELECT grp, node, count(*) AS gain FROM born GROUP BY grp, node), l AS (SELECT grp, node, count(*) AS loss FROM lost GROUP BY grp, node)
SELECT br.grp, br.node, coalesce(gain, 0) AS gain, coalesce(loss, 0) AS loss FROM br LEFT JOIN g USING (grp, node) LEFT JOIN l USING (grp, node)""")


@query("E7", DOLLO)
def dollo_gain_loss(t):
    """Gains and losses of order days along the trees of nations."""
    nodes, leaves = dendrogram(t)
    tree = B.branches(nodes, leaves)
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey").cast("long") * NAME + 1).alias("node"))
    sites = t.orders.select("o_custkey", F.to_date("o_orderdate").alias("site")).join(cust, "o_custkey").select("node", "site").distinct()
    return B.dollo(tree, sites.join(leaves, "node"))


WEIGHTS = BRANCH + """, up(step, grp, node, res) AS (SELECT 0, grp, node, 0.0::DOUBLE FROM br WHERE ndesc = 1
 UNION ALL (WITH k AS (SELECT * FROM up WHERE step < 8) SELECT step + 1, grp, node, res FROM k
 UNION ALL SELECT k.step + 1, br.grp, br.parent, CASE WHEN min(res + length) > 0 THEN min(res + length) * max(res + length) / sum(res + length) ELSE 0 END FROM k JOIN br ON br.grp = k.grp AND br.node = k.node
  WHERE br.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k z WHERE z.grp = br.grp AND z.node = br.parent) GROUP BY k.step, br.grp, br.parent HAVING count(*) = 2)),
res AS (SELECT grp, node, any_value(res) AS res FROM up GROUP BY grp, node),
arm AS (SELECT br.grp, br.node, br.parent, br.length, br.ndesc, res + length AS arm FROM br JOIN res USING (grp, node)),
sis AS (SELECT x.grp, x.node, x.parent, x.length, x.ndesc, CASE WHEN x.arm <= 0 THEN 1e-7 WHEN y.arm <= 0 THEN x.arm + y.arm ELSE x.arm END AS a, CASE WHEN x.arm <= 0 THEN y.arm + x.arm WHEN y.arm <= 0 THEN 1e-7 ELSE y.arm END AS b, y.arm AS raw
 FROM arm x JOIN arm y ON x.grp = y.grp AND x.parent = y.parent AND x.node <> y.node),
own AS (SELECT grp, parent AS node, min(a) AS a, arg_min(b, a) AS b FROM sis GROUP BY grp, parent),
dn(grp, node, length, ros, vol, lev) AS (SELECT grp, node, 0.0::DOUBLE, NULL::DOUBLE, 1.0::DOUBLE, 0 FROM br WHERE parent IS NULL
 UNION ALL SELECT grp, node, length, ros, pv * cur * CASE WHEN oa IS NULL OR ros <= 1e-7 OR oa + ob <= 1e-7 THEN 1 ELSE
  sqrt((oa * ob + ob * (length + ros)) / (1 + oa * ros / ((oa * ob / (oa + ob) + length + ros) * (oa + length + ros))) * (oa * ob + oa * (length + ros)) / (1 + ob * ros / ((oa * ob / (oa + ob) + length + ros) * (ob + length + ros)))
   / ((oa * ob + (oa + ob) * (length + ros)) * (oa + ob) * (length + ros))) END, lev + 1
 FROM (SELECT sis.grp, sis.node, sis.length, dn.vol AS pv, dn.lev, own.a AS oa, own.b AS ob,
  CASE WHEN dn.ros IS NULL THEN raw WHEN dn.ros <= 1e-7 OR sis.a + sis.b <= 1e-7 THEN 0 ELSE sis.b * dn.ros / (sis.b + dn.ros) END AS ros,
  CASE WHEN dn.ros IS NULL THEN 1 WHEN dn.ros <= 1e-7 OR sis.a + sis.b <= 1e-7 THEN 0.5 ELSE
   sqrt((sis.a + sis.b) * c * (sis.a * sis.b + sis.b * c) / (1 + sis.a * dn.ros / ((sis.a * sis.b / (sis.a + sis.b) + c) * (sis.a + c))) * (1 + sis.b * dn.ros / ((sis.a * sis.b / (sis.a + sis.b) + c) * (sis.b + c)))
    / (sis.a * sis.b + sis.a * c) / (sis.a * sis.b + (sis.a + sis.b) * c)) END AS cur
  FROM (SELECT *, dn.length + dn.ros AS c FROM dn) dn JOIN sis ON sis.grp = dn.grp AND sis.parent = dn.node LEFT JOIN own ON own.grp = sis.grp AND own.node = sis.node))"""


@query("E6 E18", tree_sql("upgma", WEIGHTS + """, lv AS (SELECT grp, node, vol FROM dn WHERE node % 1000 = 1)
SELECT x.grp, x.node // 1000 AS i, y.node // 1000 AS j, round(x.vol * y.vol / (q.vol * q.vol), 6) AS weight FROM lv x JOIN lv y ON x.grp = y.grp AND x.node < y.node
JOIN (SELECT p.grp, p.node AS n1, q.node AS n2, arg_min(p.a, p.a % 1000) AS top FROM anc p JOIN anc q ON p.grp = q.grp AND p.a = q.a GROUP BY ALL) t ON t.grp = x.grp AND t.n1 = x.node AND t.n2 = y.node
JOIN dn q ON q.grp = x.grp AND q.node = t.top"""))
def tree_pair_weights(t):
    """Three-way weights of all pairs of nations of a region."""
    nodes, leaves = dendrogram(t)
    d = B.leaf_pair_weights(B.branches(nodes, leaves), T.leaf_memberships(nodes, leaves))
    whole = lambda c: F.floor(F.col(c) / NAME).cast("long").alias(c)
    return d.select("grp", whole("i"), whole("j"), F.round("weight", 6).alias("weight"))


JOINED = QUERIES["tree_neighbour_joining"].sql.rsplit("SELECT grp, i AS node", 1)[0]
CENTRE = JOINED + """, e AS (SELECT grp, i AS x, j AS y, d FROM st WHERE kind = 'b' UNION ALL SELECT grp, j, i, d FROM st WHERE kind = 'b'),
far AS (SELECT n_regionkey AS grp, n_nationkey::BIGINT AS a, n_nationkey::BIGINT AS x, NULL::BIGINT AS prev, 0.0::DOUBLE AS dist FROM nation
 UNION ALL SELECT far.grp, far.a, e.y, e.x, dist + e.d FROM far JOIN e ON e.grp = far.grp AND e.x = far.x AND e.y IS DISTINCT FROM far.prev),
best AS (SELECT grp, arg_min(a, (-round(dist, 9), a, x)) AS a, arg_min(x, (-round(dist, 9), a, x)) AS b, max(dist) AS whole FROM far WHERE x < 4294967296 AND a < x GROUP BY grp),
pa AS (SELECT far.grp, far.x, far.dist, whole FROM best JOIN far ON far.grp = best.grp AND far.a = best.a JOIN far back ON back.grp = best.grp AND back.a = best.b AND back.x = far.x WHERE abs(far.dist + back.dist - whole) < 1e-9),
mid AS (SELECT p.grp, p.x, q.x AS y, p.whole / 2 - p.dist AS dx, q.dist - p.whole / 2 AS dy FROM pa p JOIN pa q ON p.grp = q.grp JOIN e ON e.grp = p.grp AND e.x = p.x AND e.y = q.x WHERE round(p.whole / 2 - p.dist, 9) >= 0 AND round(q.dist - p.whole / 2, 9) > 0 AND p.dist <= q.dist),
walk AS (SELECT grp, x AS node, -1::BIGINT AS parent, dx AS length, y AS prev FROM mid UNION ALL SELECT grp, y, -1, dy, x FROM mid
 UNION ALL SELECT walk.grp, e.y, e.x, e.d, walk.node FROM walk JOIN e ON e.grp = walk.grp AND e.x = walk.node AND e.y <> walk.prev)"""


def joined_tree(t):
    """Neighbour-joining trees of nations with their arbitrary roots."""
    b = B.cut_lineage(T.neighbour_joining(nation_distances(t), nation_leaves(t)))
    root = b.select("grp", F.col("parent").alias("node")).distinct().join(b.select("grp", "node"), ["grp", "node"], "left_anti")
    return B.cut_lineage(b.unionByName(root.select("grp", "node", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("double").alias("length"))))


@query("E3 E4", CENTRE + " SELECT grp, node, parent, round(length, 6) AS length FROM walk UNION ALL SELECT grp, -1, NULL, NULL FROM mid")
def tree_rooted_at_centre(t):
    """Neighbour-joining trees rooted in the middle of their longest path."""
    tree = joined_tree(t)
    return B.reroot(tree, B.centres(tree, nation_leaves(t))).withColumn("length", F.round("length", 6))


@query("E4", tree_sql("single", BRANCH + """, rt AS (SELECT grp, node AS root, ndesc AS total FROM br WHERE parent IS NULL),
cut AS (SELECT br.grp, arg_min(br.node, (abs(total - 2 * ndesc), br.node)) AS node FROM br JOIN rt USING (grp) WHERE parent IS NOT NULL GROUP BY br.grp),
e AS (SELECT grp, node AS x, parent AS y, length AS d FROM br WHERE parent IS NOT NULL UNION ALL SELECT grp, parent, node, length FROM br WHERE parent IS NOT NULL),
walk AS (SELECT cut.grp, cut.node, -1::BIGINT AS parent, length / 2 AS length, br.parent AS prev FROM cut JOIN br ON br.grp = cut.grp AND br.node = cut.node UNION ALL SELECT cut.grp, br.parent, -1, length / 2, cut.node FROM cut JOIN br ON br.grp = cut.grp AND br.node = cut.node
 UNION ALL SELECT walk.grp, e.y, e.x, e.d, walk.node FROM walk JOIN e ON e.grp = walk.grp AND e.x = walk.node AND e.y <> walk.prev),
lone AS (SELECT w.grp, w.node, w.parent, w.length FROM walk w JOIN rt ON rt.grp = w.grp AND rt.root = w.node WHERE (SELECT count(*) FROM walk z WHERE z.grp = w.grp AND z.parent = w.node) = 1)
SELECT w.grp, w.node, CAST(coalesce(lone.parent, w.parent) AS BIGINT) AS parent, round(w.length + coalesce(lone.length, 0), 6) AS length FROM walk w LEFT JOIN lone ON lone.grp = w.grp AND lone.node = w.parent
WHERE NOT EXISTS (SELECT 1 FROM lone z WHERE z.grp = w.grp AND z.node = w.node) UNION ALL SELECT grp, -1, NULL, NULL FROM cut"""))
def tree_balanced(t):
    """Single-linkage trees of nations, rooted where the leaves are halved best."""
    nodes, leaves = dendrogram(t, "single")
    tree = B.branches(nodes, leaves)
    return B.reroot(tree, B.balance_points(tree)).withColumn("length", F.round("length", 6))


LEAST, MOST = 1, 2
DIVIDE = tree_sql("single", BRANCH + f""", kid AS (SELECT m.grp, m.parent AS node, arg_min(m.node, (-m.ndesc, m.node)) AS c, max(m.ndesc) AS nc, arg_max(m.node, (-m.ndesc, m.node)) AS d, min(m.ndesc) AS nd FROM br m WHERE m.parent IS NOT NULL GROUP BY m.grp, m.parent),
dv(grp, node, part, n, e, kind) AS (SELECT grp, node, node, ndesc, 0::BIGINT, 's' FROM br WHERE parent IS NULL
 UNION ALL (WITH x AS (SELECT dv.*, kid.c, nc, d, nd, CASE WHEN n + e <= {MOST} OR n <= {MOST} THEN 0 WHEN CASE WHEN e = 0 THEN nd ELSE least(nc, nd + e) END > {LEAST} THEN 1 WHEN nc <= {MOST} OR (e > 0 AND nc <= nd + e) THEN 0 ELSE 2 END AS act
  FROM dv LEFT JOIN kid ON kid.grp = dv.grp AND kid.node = dv.node WHERE kind = 's')
 SELECT grp, node, part, n, e, 'p' FROM x WHERE act = 0
 UNION ALL SELECT grp, c, c, nc, 0, 's' FROM x WHERE act = 1 UNION ALL SELECT grp, d, CASE WHEN e = 0 THEN d ELSE part END, nd, e, 's' FROM x WHERE act = 1
 UNION ALL SELECT grp, c, part, nc, e + nd, 's' FROM x WHERE act = 2 UNION ALL SELECT grp, d, part, nd, 0, 'p' FROM x WHERE act = 2)),
pt AS (SELECT grp, node, part, n FROM dv WHERE kind = 'p')
SELECT pt.grp, pt.node, pt.part, CAST(sum(n) OVER (PARTITION BY pt.grp, pt.part) AS BIGINT) AS size, sum(n) OVER (PARTITION BY pt.grp, pt.part) <= {LEAST} AS outlier FROM pt""")


@query("E10 E13", DIVIDE)
def tree_division(t):
    """Dendrograms of nations dealt into parts of two, small subtrees grafted."""
    return B.divide(*dendrogram(t, "single"), LEAST, MOST)


PRUNE_AT, PRUNE_LEAST = 0.06, 4
PRUNED = tree_sql("upgma", BRANCH + f""", pn(grp, node, kept, leaf) AS (SELECT grp, node, ndesc >= {PRUNE_LEAST} OR (ndesc > 1 AND h <= {PRUNE_AT} * (1 - 1.0 / ndesc)), ndesc = 1 FROM br WHERE parent IS NULL
 UNION ALL SELECT br.grp, br.node, ndesc >= {PRUNE_LEAST} OR (ndesc > 1 AND h <= {PRUNE_AT} * (1 - 1.0 / ndesc)), ndesc = 1 FROM pn JOIN br ON br.grp = pn.grp AND br.parent = pn.node WHERE NOT kept)
SELECT grp, node, kept FROM pn WHERE kept OR leaf""")


@query("E11", PRUNED.replace(f"ndesc >= {PRUNE_LEAST} OR", "ndesc >= 6 OR"))
def tree_pruned(t):
    """What stays together below a height, and the nations that stand alone."""
    return B.prune(*dendrogram(t), PRUNE_AT, 6)


@query("T5 K15", tree_sql("upgma", BRANCH + """, side AS (SELECT grp, node, row_number() OVER (PARTITION BY grp, parent ORDER BY node // 1000) - 1 AS s FROM br WHERE parent IS NOT NULL),
way AS (SELECT anc.grp, anc.node, string_agg(CAST(s AS VARCHAR), '' ORDER BY k DESC) AS w FROM anc JOIN side ON side.grp = anc.grp AND side.node = anc.a GROUP BY anc.grp, anc.node)
SELECT br.grp, br.node // 1000 AS leaf, CAST(row_number() OVER (PARTITION BY br.grp ORDER BY coalesce(w, '')) AS BIGINT) AS place, length(coalesce(w, '')) AS depth FROM br LEFT JOIN way USING (grp, node) WHERE ndesc = 1"""))
def tree_order(t):
    """Place of every leaf in its tree, first leaves first, and its depth."""
    nodes, leaves = dendrogram(t)
    m = T.leaf_memberships(nodes, leaves)
    # children by their first leaf, as the left one is named by it
    left = nodes.select("grp", "node", (F.floor(F.col("left") / NAME) < F.floor(F.col("right") / NAME)).alias("plain"))
    step = F.when(F.col("plain") == (F.col("side") == 0), F.lit("0")).otherwise(F.lit("1"))
    way = m.join(left, ["grp", "node"]).groupBy("grp", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("node") % NAME).alias("k"), step.alias("s")))).alias("w"))
    way = way.select("grp", "leaf", F.array_join("w.s", "").alias("w"))
    from pyspark.sql import Window as W

    d = leaves.select("grp", F.col("node").alias("leaf")).join(way, ["grp", "leaf"], "left").withColumn("w", F.coalesce("w", F.lit("")))
    place = F.row_number().over(W.partitionBy("grp").orderBy("w")).cast("long")  # the leaves of one tree
    return d.select("grp", F.floor(F.col("leaf") / NAME).cast("long").alias("leaf"), place.alias("place"), F.length("w").cast("long").alias("depth"))
