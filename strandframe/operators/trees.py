"""Distance trees for many groups at once: agglomerative linkage and neighbour joining.

Distances are an edge table ``(grp, i, j, d)``.  A linkage round merges every
reciprocal nearest pair of every group in one job; neighbour joining merges one
pair per group and round.  No group is gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.session import cut_lineage

LINKAGE = {
    "upgma": lambda: (F.sum(F.col("d") * F.col("n")) / F.sum("n")),
    "single": lambda: F.min("d"),
    "complete": lambda: F.max("d"),
    "mean": lambda: F.avg("d"),
}


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("grp", "i", "j", "d").unionByName(edges.select("grp", F.col("j").alias("i"), F.col("i").alias("j"), "d"))


def _none(like: DataFrame, columns: str) -> DataFrame:
    """An empty frame with the group column of ``like`` and ``columns`` given as ``type name``."""
    fields = ", ".join(" ".join(reversed(c.split())) for c in columns.split(", "))
    return like.sparkSession.createDataFrame([], f"grp {dict(like.dtypes)['grp']}, {fields}")


def _stride(leaves: DataFrame) -> int:
    """Distance between the ids of two rounds: above every leaf id."""
    top, most = leaves.agg(F.max("node"), F.count("*")).first()
    stride = max(2**32, int(top or 0) + 1)
    if stride * (int(most) + 1) >= 2**63:
        raise ValueError("leaf ids are too large for node ids; renumber them first")
    return stride


def _relabel(edges: DataFrame, merges: DataFrame, sizes: DataFrame, method: str) -> DataFrame:
    """Replace endpoint ``i`` by its merged cluster and combine parallel edges."""
    m = merges.select("grp", F.explode(F.array(F.struct(F.col("a").alias("i")), F.struct(F.col("b").alias("i")))).alias("x"), "a", F.col("d").alias("dab"))
    m = m.select("grp", "x.i", F.col("a").alias("to"), "dab")
    n = sizes.select("grp", F.col("node").alias("i"), "n")
    d = edges.join(n, ["grp", "i"]).join(m, ["grp", "i"], "left").withColumn("i", F.coalesce("to", "i"))
    if method == "ward":
        nk = sizes.select("grp", F.col("node").alias("j"), F.col("n").alias("nk"))
        d = d.join(nk, ["grp", "j"])
        merged = (F.sum((F.col("n") + F.col("nk")) * F.col("d")) - F.first("nk") * F.first("dab")) / (F.sum("n") + F.first("nk"))
        value = F.when(F.count("*") > 1, merged).otherwise(F.first("d"))
    else:
        value = LINKAGE[method]()
    return d.groupBy("grp", "i", "j").agg(value.alias("d"))


def linkage(edges: DataFrame, leaves: DataFrame, method: str = "upgma") -> DataFrame:
    """Internal nodes ``(grp, node, left, right, height, ndesc)``.

    ``edges``: complete distances per group; ``leaves``: ``(grp, node)`` with
    node ids >= 0.  A cluster keeps the smallest leaf id of its members as
    label; the node id is ``round * stride + label`` with ``stride`` over every leaf id.
    Without edges there is no internal node.
    """
    stride = _stride(leaves)
    sizes = cut_lineage(leaves.select("grp", "node", F.lit(1).cast("long").alias("n"), F.col("node").cast("long").alias("id")))
    e = cut_lineage(both_ways(edges.withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long"))))
    out, step = [], 0
    while not e.isEmpty():
        step += 1
        key = F.struct("d", F.least("i", "j"), F.greatest("i", "j"))
        near = e.groupBy("grp", "i").agg(F.min_by(F.struct("j", "d"), key).alias("x")).select("grp", "i", "x.*")
        back = near.select("grp", F.col("i").alias("j"), F.col("j").alias("i"))
        pairs = near.join(back, ["grp", "i", "j"]).filter("i < j").select("grp", F.col("i").alias("a"), F.col("j").alias("b"), "d")
        left = sizes.select("grp", F.col("node").alias("a"), F.col("n").alias("na"), F.col("id").alias("left"))
        right = sizes.select("grp", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("id").alias("right"))
        merges = cut_lineage(
            pairs.join(left, ["grp", "a"]).join(right, ["grp", "b"]).withColumn("id", F.col("a") + F.lit(step * stride)).withColumn("n", F.col("na") + F.col("nb"))
        )
        out.append(merges.select("grp", F.col("id").alias("node"), "left", "right", (F.col("d") / 2).alias("height"), F.col("n").alias("ndesc")))
        inner = e.join(merges.select("grp", F.col("a").alias("i"), F.col("b").alias("j")), ["grp", "i", "j"], "left_anti")
        inner = inner.join(merges.select("grp", F.col("b").alias("i"), F.col("a").alias("j")), ["grp", "i", "j"], "left_anti")
        half = _relabel(inner, merges, sizes, method)
        merged_sizes = sizes.join(
            merges.select("grp", F.explode(F.array("a", "b")).alias("node")), ["grp", "node"], "left_anti"
        ).unionByName(merges.select("grp", F.col("a").alias("node"), "n", "id"))
        swapped = half.select("grp", F.col("j").alias("i"), F.col("i").alias("j"), "d")
        mixed = sizes.unionByName(merges.select("grp", F.col("a").alias("node"), "n", "id")).groupBy("grp", "node").agg(F.max("n").alias("n"), F.max("id").alias("id"))
        e2 = _relabel_other(swapped, merges, sizes, mixed, method)
        e = cut_lineage(e2)
        sizes = cut_lineage(merged_sizes)
    none = "long node, long left, long right, double height, long ndesc"
    return reduce(DataFrame.unionByName, out) if out else _none(edges, none)


def _relabel_other(swapped: DataFrame, merges: DataFrame, sizes: DataFrame, after: DataFrame, method: str) -> DataFrame:
    """Second endpoint: sizes before the round on the merged side, after it on the other."""
    if method != "ward":
        return _relabel(swapped, merges, sizes, method)
    m = merges.select("grp", F.explode(F.array("a", "b")).alias("i"), F.col("a").alias("to"), F.col("d").alias("dab"))
    n = sizes.select("grp", F.col("node").alias("i"), "n")
    nk = after.select("grp", F.col("node").alias("j"), F.col("n").alias("nk"))
    d = swapped.join(n, ["grp", "i"]).join(nk, ["grp", "j"]).join(m, ["grp", "i"], "left").withColumn("i", F.coalesce("to", "i"))
    merged = (F.sum((F.col("n") + F.col("nk")) * F.col("d")) - F.first("nk") * F.first("dab")) / (F.sum("n") + F.first("nk"))
    return d.groupBy("grp", "i", "j").agg(F.when(F.count("*") > 1, merged).otherwise(F.first("d")).alias("d"))


def neighbour_joining(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Branches ``(grp, node, parent, length)`` of the unrooted tree of every group; ids as in ``linkage``.

    A negative branch becomes zero and its sister takes the difference, so path lengths of the pair stay.
    """
    stride = _stride(leaves)
    e = cut_lineage(both_ways(edges.withColumn("i", F.col("i").cast("long")).withColumn("j", F.col("j").cast("long"))))
    out, step = [], 0
    while not e.isEmpty():
        step += 1
        sums = e.groupBy("grp", "i").agg(F.sum("d").alias("r"))
        count = sums.groupBy("grp").agg(F.count("*").alias("m"))
        q = (
            e.filter("i < j").join(sums.withColumnRenamed("r", "ri"), ["grp", "i"])
            .join(sums.select("grp", F.col("i").alias("j"), F.col("r").alias("rj")), ["grp", "j"]).join(count, "grp")
        )
        q = q.withColumn("q", F.round((F.col("m") - 2) * F.col("d") - F.col("ri") - F.col("rj"), 9))
        pick = q.groupBy("grp").agg(F.min(F.struct("q", "i", "j", "d", "ri", "rj", "m")).alias("x")).select("grp", "x.*")
        slope = F.when(F.col("m") > 2, (F.col("ri") - F.col("rj")) / (2 * (F.col("m") - 2))).otherwise(F.lit(0.0))
        pick = cut_lineage(
            pick.withColumn("u", F.col("i") % F.lit(stride) + F.lit(step * stride)).withColumn("li", F.greatest(F.lit(0.0), F.least("d", F.col("d") / 2 + slope))).withColumn("lj", F.col("d") - F.col("li"))
        )
        last = F.col("m") == 2
        out.append(pick.select("grp", F.explode(F.when(last, F.array(F.struct(F.col("i").alias("node"), F.col("j").alias("parent"), F.col("d").alias("length")))).otherwise(
            F.array(F.struct(F.col("i").alias("node"), F.col("u").alias("parent"), F.col("li").alias("length")),
                    F.struct(F.col("j").alias("node"), F.col("u").alias("parent"), F.col("lj").alias("length"))))).alias("b")).select("grp", "b.*"))
        gone = pick.select("grp", F.explode(F.array("i", "j")).alias("x"))
        stay = e.join(gone.withColumnRenamed("x", "i"), ["grp", "i"], "left_anti").join(gone.withColumnRenamed("x", "j"), ["grp", "j"], "left_anti").select("grp", "i", "j", "d")
        member = pick.select("grp", F.col("i").alias("pi"), F.col("j").alias("pj"), F.col("d").alias("dij"), "u")
        touch = e.join(member, "grp").filter("(i = pi OR i = pj) AND j <> pi AND j <> pj")
        fresh = touch.groupBy("grp", "u", "j").agg(((F.sum("d") - F.first("dij")) / 2).alias("d"))
        fresh = fresh.select("grp", F.col("u").alias("i"), "j", "d")
        e = cut_lineage(stay.unionByName(fresh).unionByName(fresh.select("grp", F.col("j").alias("i"), F.col("i").alias("j"), "d")))
    return reduce(DataFrame.unionByName, out) if out else _none(edges, "long node, long parent, double length")


def leaf_memberships(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(grp, leaf, node, height, side)`` for every ancestor, walking up one level per round."""
    up = nodes.select("grp", F.explode(F.array(F.struct(F.col("left").alias("child"), F.lit(0).alias("side")), F.struct(F.col("right").alias("child"), F.lit(1).alias("side")))).alias("c"), "node", "height")
    up = cut_lineage(up.select("grp", "c.child", "c.side", "node", "height"))
    front = leaves.select("grp", F.col("node").alias("leaf"), F.col("node").cast("long").alias("child"))
    out = []
    while True:
        front = cut_lineage(front.join(up, ["grp", "child"]))
        if front.isEmpty():
            break
        out.append(front.select("grp", "leaf", "node", "height", "side"))
        front = front.select("grp", "leaf", F.col("node").alias("child"))
    return reduce(DataFrame.unionByName, out) if out else _none(nodes, "long leaf, long node, double height, int side")


def member_weights(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaf weights by current division: at each node current splits inversely to branch resistance."""
    child = nodes.select("grp", "node", F.explode(F.array("left", "right")).alias("child"), "height")
    own = nodes.select("grp", F.col("node").alias("child"), F.col("height").alias("ch"))
    branch = cut_lineage(child.join(own, ["grp", "child"], "left").select("grp", "node", "child", (F.col("height") - F.coalesce("ch", F.lit(0.0))).alias("len")))
    known = leaves.select("grp", F.col("node").cast("long").alias("child"), F.lit(0.0).alias("res"))
    todo, resist = nodes.select("grp", "node"), known
    while True:
        ready = branch.join(known.select("grp", "child", "res"), ["grp", "child"]).groupBy("grp", "node").agg(
            F.count("*").alias("k"), F.sum(F.lit(1.0) / F.greatest(F.col("len") + F.col("res"), F.lit(1e-9))).alias("cond")
        ).filter("k = 2").join(todo, ["grp", "node"])
        ready = cut_lineage(ready.select("grp", "node", (1.0 / F.col("cond")).alias("res")))
        if ready.isEmpty():
            break
        todo = cut_lineage(todo.join(ready.select("grp", "node"), ["grp", "node"], "left_anti"))
        known = cut_lineage(known.unionByName(ready.select("grp", F.col("node").alias("child"), "res")))
    share = branch.join(known, ["grp", "child"]).withColumn("g", F.lit(1.0) / F.greatest(F.col("len") + F.col("res"), F.lit(1e-9)))
    total = share.groupBy("grp", "node").agg(F.sum("g").alias("tot"))
    share = share.join(total, ["grp", "node"]).select("grp", "child", "node", (F.col("g") / F.col("tot")).alias("share"))
    walk = leaf_memberships(nodes, leaves).select("grp", "leaf", "node")
    own_leaf = leaves.select("grp", F.col("node").alias("leaf"), F.col("node").cast("long").alias("child"))
    path = own_leaf.unionByName(walk.select("grp", "leaf", F.col("node").alias("child")))
    return path.join(share, ["grp", "child"]).groupBy("grp", "leaf").agg(F.exp(F.sum(F.log("share"))).alias("weight"))


def cophenetic(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Tree distance of leaf pairs ``(grp, i, j, dist)``: twice the height of the node that splits them."""
    m = leaf_memberships(nodes, leaves)
    a = m.filter("side = 0").select("grp", "node", "height", F.col("leaf").alias("x"))
    b = m.filter("side = 1").select("grp", "node", F.col("leaf").alias("y"))
    return a.join(b, ["grp", "node"]).select("grp", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("height") * 2).alias("dist"))


def leaf_paths(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Inner nodes on the path between two leaves: ``(grp, i, j, steps)``, i < j."""
    m = leaf_memberships(nodes, leaves)
    level = F.row_number().over(W.partitionBy("grp", "leaf").orderBy("height", "node"))  # the ancestors of one leaf
    m = cut_lineage(m.withColumn("level", level))
    a = m.filter("side = 0").select("grp", "node", F.col("leaf").alias("x"), F.col("level").alias("p"))
    b = m.filter("side = 1").select("grp", "node", F.col("leaf").alias("y"), F.col("level").alias("q"))
    return a.join(b, ["grp", "node"]).select("grp", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("p") + F.col("q") - 1).alias("steps"))


def cut_tree(nodes: DataFrame, leaves: DataFrame, height: float) -> DataFrame:
    """Cluster of every leaf when the tree is cut at ``height``: its highest ancestor not above it."""
    m = leaf_memberships(nodes, leaves).filter(F.col("height") <= height)
    top = m.groupBy("grp", "leaf").agg(F.max_by("node", F.struct("height", "node")).alias("cluster"))
    return leaves.select("grp", F.col("node").alias("leaf")).join(top, ["grp", "leaf"], "left").select(
        "grp", "leaf", F.coalesce("cluster", F.col("leaf").cast("long")).alias("cluster")
    )


def newick_text(nodes: DataFrame, leaves: DataFrame, digits: int = 4) -> DataFrame:
    """``(grp, newick)``: child texts are joined upwards, one tree level per round."""
    own = nodes.select("grp", F.col("node").alias("child"), F.col("height").alias("ch"))
    child = nodes.select("grp", "node", "height", F.explode(F.array("left", "right")).alias("child")).join(own, ["grp", "child"], "left")
    branch = cut_lineage(child.select("grp", "node", "child", F.format_number(F.col("height") - F.coalesce("ch", F.lit(0.0)), digits).alias("len")))
    known = leaves.select("grp", F.col("node").cast("long").alias("child"), F.col("node").cast("string").alias("text"))
    todo = nodes.select("grp", "node")
    while True:
        part = F.concat("text", F.lit(":"), "len")
        ready = branch.join(known, ["grp", "child"]).groupBy("grp", "node").agg(F.array_sort(F.collect_list(F.struct("child", part.alias("t")))).alias("parts"))
        ready = ready.filter(F.size("parts") == 2).join(todo, ["grp", "node"])
        ready = cut_lineage(ready.select("grp", F.col("node").alias("child"), F.concat(F.lit("("), F.array_join(F.col("parts.t"), ","), F.lit(")")).alias("text")))
        if ready.isEmpty():
            break
        todo = cut_lineage(todo.join(ready.select("grp", F.col("child").alias("node")), ["grp", "node"], "left_anti"))
        known = cut_lineage(known.unionByName(ready))
    root = nodes.join(branch.select("grp", F.col("child").alias("node")), ["grp", "node"], "left_anti").select("grp", F.col("node").alias("child"))
    return known.join(root, ["grp", "child"]).select("grp", F.concat("text", F.lit(";")).alias("newick"))
