"""Queries of coordinate maps through gaps, and of regions over the splits of a tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import residues as R
from strandframe.operators import alignment_columns as A, bipartitions as S, gap_maps as M, progressive as P
from strandframe.plans.alignment_queries import SEG_SQL
from strandframe.plans.fragments import CELLS, ROWS
from strandframe.plans.registry import query
from strandframe.session import cut_lineage

KEYS = ["msa_id", "member"]
NUMBERED = f"WITH {CELLS}, res AS (SELECT msa_id, member, site, row_number() OVER (PARTITION BY msa_id, member ORDER BY site) AS x FROM cells WHERE r <> '-')"


def row_maps(t):
    """Maps from residues to sites of all rows, and the rows' widths."""
    spans = t.rows.select(*KEYS, F.length("a").alias("width"))
    return M.from_gaps(A.gap_runs(t.rows), spans, KEYS), spans


def stretches(of, width):
    """Every stretch of eight from each tenth position on."""
    k = F.explode(F.expr(f"sequence(1L, cast({width} as bigint), 10L)"))
    return of.filter(F.col(width) > 0).select(*KEYS, k.alias("k"), F.col(width)).select(*KEYS, "k", F.col("k").alias("l"), F.least(F.col("k") + 7, F.col(width).cast("long")).alias("r"))


@query("G5 W1 P28", NUMBERED + """, w AS (SELECT msa_id, member, max(x) AS n FROM res GROUP BY ALL), iv AS (SELECT msa_id, member, unnest(range(1, n + 1, 10)) AS k, n FROM w)
SELECT iv.msa_id, iv.member, k, a.site AS l, b.site AS r FROM iv JOIN res a ON a.msa_id = iv.msa_id AND a.member = iv.member AND a.x = k JOIN res b ON b.msa_id = iv.msa_id AND b.member = iv.member AND b.x = least(k + 7, n)""")
def intervals_unfolded(t):
    """Stretches of residues as sites of their rows."""
    maps, _ = row_maps(t)
    count = maps.groupBy(*KEYS).agg(F.max("x_r").alias("n"))
    return M.image(stretches(count, "n"), maps, KEYS, ["k"])


@query("G5", NUMBERED + """, w AS (SELECT msa_id, member, max(site) AS n FROM cells GROUP BY ALL), iv AS (SELECT msa_id, member, unnest(range(1, n + 1, 10)) AS k, n FROM w)
SELECT iv.msa_id, iv.member, k, min(x) AS l, max(x) AS r FROM iv JOIN res ON res.msa_id = iv.msa_id AND res.member = iv.member AND site BETWEEN k AND least(k + 7, n) GROUP BY iv.msa_id, iv.member, k""")
def intervals_folded(t):
    """Stretches of sites as residues of their rows."""
    maps, spans = row_maps(t)
    return M.image(stretches(spans, "width"), M.inverse(maps, KEYS), KEYS, ["k"])


COMMON = NUMBERED + """, kept AS (SELECT msa_id, site, row_number() OVER (PARTITION BY msa_id ORDER BY site) AS y FROM (SELECT DISTINCT msa_id, site FROM res)),
n AS (SELECT msa_id, member, x, y, y - x AS shift FROM res JOIN kept USING (msa_id, site))"""


@query("G9 G10", COMMON + " SELECT msa_id, member, min(x) AS x_l, max(x) AS x_r, min(y) AS y_l FROM n GROUP BY msa_id, member, shift")
def common_gaps_removed(t):
    """Rows' maps after the columns that are gaps in all members are gone: one map after the other."""
    maps, spans = row_maps(t)
    common = M.common_gaps(A.gap_runs(t.rows), spans, KEYS, "msa_id")
    return M.compose(maps, M.squeeze(common, spans, "msa_id"), KEYS, ["msa_id"])


@query("G9 D16", COMMON + """, p AS (SELECT msa_id, member, y, lag(y, 1, 0) OVER (PARTITION BY msa_id, member ORDER BY x) AS b FROM n)
SELECT msa_id, member, b AS gps, y - b - 1 AS gln FROM p WHERE y - b > 1""")
def gap_lists_normalized(t):
    """Gap lists of the rows without common gaps."""
    return M.gaps_of(common_gaps_removed(t), KEYS)


@query("G9 D17", NUMBERED + """, ins AS (SELECT msa_id, member, x AS at FROM res WHERE x % 50 = 0), m AS (SELECT res.msa_id, res.member, res.x, res.site + 3 * count(ins.at) AS y FROM res LEFT JOIN ins ON ins.msa_id = res.msa_id AND ins.member = res.member AND ins.at < res.x GROUP BY res.msa_id, res.member, res.x, res.site)
SELECT msa_id, member, min(x) AS x_l, max(x) AS x_r, min(y) AS y_l FROM m GROUP BY msa_id, member, y - x""")
def gaps_inserted(t):
    """Three columns go in after every fiftieth residue of a row, wherever that is by then."""
    maps, spans = row_maps(t)
    fifty = M._spread(maps, F.col("x_l") * 256 / 50, F.col("x_r") * 256 / 50, "q").filter("q > 0").withColumn("at", F.col("q") * 50).filter("at >= x_l AND at <= x_r")
    sites = fifty.select(*KEYS, (F.col("y_l") + F.col("at") - F.col("x_l")).alias("site"), F.floor(F.col("at") / 50).alias("c"))
    # the c-th insertion moves what follows by three sites
    gaps = sites.select(*KEYS, (F.col("site") + (F.col("c") - 1) * 3).alias("gps"), F.lit(3).alias("gln"))
    more = gaps.groupBy(*KEYS).agg((F.count("*") * 3).alias("more"))
    wide = spans.join(more, KEYS, "left").select(*KEYS, (F.col("width") + F.coalesce("more", F.lit(0))).alias("width"))
    return M.compose(maps, M.from_gaps(gaps, wide, KEYS), KEYS, KEYS)


LEVELS, FUSE, SEGMENT = 10, 24, 12
TREE = f"""tr0 AS (SELECT msa_id, member, lv AS level, lv * 1099511627776 + (member >> lv) AS node, (member >> (lv - 1)) & 1 AS side FROM rws, range(1, {LEVELS} + 1) AS u(lv)),
tr AS (SELECT * FROM tr0 WHERE (msa_id, node) IN (SELECT (msa_id, node) FROM tr0 GROUP BY msa_id, node HAVING min(side) < max(side))),
mem AS (SELECT DISTINCT msa_id, member FROM cells), wid AS (SELECT msa_id, max(site) AS width FROM cells GROUP BY msa_id)"""
SPLITS = f"""{CELLS}, {TREE},
sd AS (SELECT * FROM (SELECT msa_id, member, node FROM tr WHERE (msa_id, level) NOT IN (SELECT (msa_id, max(level)) FROM tr GROUP BY msa_id) UNION ALL SELECT msa_id, member, -1 - member FROM mem) WHERE msa_id IN (SELECT msa_id FROM mem GROUP BY msa_id HAVING count(*) > 1)),
own AS (SELECT c.msa_id, sd.node, c.site, c.r, count(*) AS k FROM cells c JOIN sd USING (msa_id, member) WHERE c.r <> '-' GROUP BY ALL), tl AS (SELECT msa_id, site, r, count(*) AS n FROM cells WHERE r <> '-' GROUP BY ALL),
hit AS (SELECT DISTINCT own.msa_id, node, site FROM own JOIN tl USING (msa_id, site, r) WHERE k < n),
sc AS (SELECT CAST(g.msa_id AS VARCHAR) || ':' || g.node AS msa_id, g.site, CAST(CASE WHEN hit.site IS NULL THEN -1 ELSE 4 END AS BIGINT) AS v
 FROM (SELECT n.msa_id, node, unnest(range(1, width + 1)) AS site FROM (SELECT DISTINCT msa_id, node FROM sd) n JOIN wid USING (msa_id)) g LEFT JOIN hit USING (msa_id, node, site)),"""
_O = SEG_SQL.index("o AS (")
REGIONS = f"WITH RECURSIVE {SPLITS} " + SEG_SQL[_O:].replace("SELECT msa_id, ol AS l, orr AS r, os AS score FROM st WHERE closed", """, cov AS (SELECT CAST(split_part(msa_id, ':', 1) AS BIGINT) AS msa_id, unnest(range(ol, orr + 1)) AS site FROM st WHERE closed),
al AS (SELECT wid.msa_id, unnest(range(1, width + 1)) AS site FROM wid), spl AS (SELECT msa_id, count(DISTINCT node) AS splits FROM sd GROUP BY msa_id),
fl AS (SELECT al.msa_id, al.site, count(cov.site) = any_value(splits) AS conserved FROM al JOIN spl USING (msa_id) LEFT JOIN cov ON cov.msa_id = al.msa_id AND cov.site = al.site GROUP BY al.msa_id, al.site),
rn AS (SELECT *, site - row_number() OVER (PARTITION BY msa_id, conserved ORDER BY site) AS g FROM fl)
SELECT msa_id, min(site) AS l, max(site) AS r, conserved FROM rn GROUP BY msa_id, conserved, g""")


def turn_tree(t):
    """The binary tree over turn numbers as a tree of the members."""
    top = t.rows.agg(F.max("member")).first()[0] or 0
    return cut_lineage(S.binary_tree(t.rows, max(1, int(top).bit_length())))


@query("W6", REGIONS)
def regions_over_splits(t):
    """Sites conserved between the two sides of every split of the tree of turns, and the divergent rest."""
    return S.regions(t.rows, turn_tree(t), SEGMENT)


@query("W6b E12", f"""WITH RECURSIVE {CELLS}, {TREE},
met AS (SELECT DISTINCT c.msa_id, tr.node, c.site FROM cells c JOIN tr USING (msa_id, member) WHERE c.r <> '-' GROUP BY c.msa_id, tr.node, c.site, c.r HAVING min(side) < max(side)),
ln AS (SELECT g.msa_id, g.node, g.site, CASE WHEN met.site IS NULL THEN -1 ELSE 4 END AS v FROM (SELECT n.msa_id, node, unnest(range(1, width + 1)) AS site FROM (SELECT DISTINCT msa_id, node FROM tr) n JOIN wid USING (msa_id)) g LEFT JOIN met USING (msa_id, node, site)),
ps AS (SELECT msa_id, node, site, sum(v) OVER (PARTITION BY msa_id, node ORDER BY site) AS s, v FROM ln),
pm AS (SELECT msa_id, node, s - greatest(0, max(s - v) OVER (PARTITION BY msa_id, node ORDER BY site)) AS d FROM ps),
bad AS (SELECT msa_id, node FROM pm GROUP BY msa_id, node HAVING min(d) < -{FUSE}),
up AS (SELECT DISTINCT b.msa_id, y.node FROM bad b JOIN tr x ON x.msa_id = b.msa_id AND x.node = b.node JOIN tr y ON y.msa_id = x.msa_id AND y.member = x.member AND y.level >= x.level),
best AS (SELECT msa_id, member, arg_max(node, level) AS node FROM tr WHERE (msa_id, node) NOT IN (SELECT (msa_id, node) FROM up) GROUP BY msa_id, member),
gr AS (SELECT mem.msa_id, mem.member, coalesce(node, -1 - mem.member) AS node FROM mem LEFT JOIN best USING (msa_id, member))
SELECT msa_id, member, CAST(node AS BIGINT) AS node, CAST(count(*) OVER (PARTITION BY msa_id, node) AS BIGINT) AS size FROM gr""")
def fusible_groups(t):
    """Turns that may be fused to groups, walking up the tree of turns."""
    return S.fused_members(t.rows, turn_tree(t), FUSE)


def standing(rows):
    """Maps from residues to columns that any of the rows uses, as one number per row."""
    spans = rows.select(*KEYS, F.length("a").alias("width"))
    runs = A.gap_runs(rows)
    used = M.squeeze(M.common_gaps(runs, spans, KEYS, "msa_id"), spans, "msa_id")
    maps = M.compose(M.from_gaps(runs, spans, KEYS), used, KEYS, ["msa_id"])
    return maps.groupBy(*KEYS).agg(F.sum(F.xxhash64("x_l", "x_r", "y_l").cast("decimal(38,0)")).alias("h"))


@query("J19 I2 D17", f"""WITH {ROWS}, r AS (SELECT msa_id, member, replace(a, '-', '') AS s FROM rws), first AS (SELECT msa_id, min(member) AS member FROM r GROUP BY msa_id)
SELECT msa_id, member, CASE WHEN (msa_id, member) IN (SELECT (msa_id, member) FROM first) THEN reverse(s) ELSE s END AS residues, true AS same_width, true AS untouched FROM r
UNION ALL SELECT r.msa_id, -1, s, true, true FROM r JOIN first USING (msa_id, member)""")
def members_replaced(t):
    """The first turn of every conversation gives way to its own reverse, and comes back as a new member; the others keep their places."""
    rows = t.rows.select(*KEYS, "a")
    first = rows.groupBy("msa_id").agg(F.min(F.struct("member", "a")).alias("x")).select("msa_id", "x.member", R.ungap("x.a").alias("s"))
    guests = first.select("msa_id", "member", F.reverse("s").alias("s")).unionByName(first.select("msa_id", F.lit(-1).cast("long").alias("member"), "s"))
    new = cut_lineage(P.update_members(rows, guests))
    width = new.groupBy("msa_id").agg((F.max(F.length("a")) == F.min(F.length("a"))).alias("same_width"))
    stay = lambda d: d.join(guests.select(*KEYS), KEYS, "left_anti")
    before, after = standing(stay(rows)), standing(stay(new)).withColumnRenamed("h", "k")
    moved = before.join(after, KEYS, "full").select(*KEYS, F.coalesce(F.col("h") == F.col("k"), F.lit(False)).alias("untouched"))
    d = new.join(width, "msa_id").join(moved, KEYS, "left")
    return d.select(*KEYS, R.ungap("a").alias("residues"), "same_width", F.coalesce("untouched", F.lit(True)).alias("untouched"))
