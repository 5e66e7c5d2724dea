"""Rooted trees as branch tables ``(grp, node, parent, length, ndesc)``: rooting, weights, parsimony, division.

The root has no parent; ``ndesc`` counts leaves.  A pass over a tree is one join per
level for all groups and all sites at once: upward, children's values are gathered
at their parent; downward, every node gets what its parent hands on.  No tree is
gathered in one task.  Results of a pass are cut off by a reliable checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from strandframe.session import cut_lineage

#: Resistances and lengths below this count as none.
TINY = 1e-7
KEY = ["grp", "node"]


def branches(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Branch table of a dendrogram from ``trees.linkage``, with ``height``."""
    own = nodes.select("grp", "node", "height", "ndesc").unionByName(
        leaves.select("grp", F.col("node").cast("long").alias("node"), F.lit(0.0).alias("height"), F.lit(1).cast("long").alias("ndesc")))
    up = nodes.select("grp", F.explode(F.array("left", "right")).alias("node"), F.col("node").alias("parent"), F.col("height").alias("above"))
    d = own.join(up, KEY, "left")
    return cut_lineage(d.select("grp", "node", "parent", (F.col("above") - F.col("height")).alias("length"), "ndesc", "height"))


def levelled(tree: DataFrame) -> tuple[DataFrame, int]:
    """The tree with ``level`` (root 0), and the deepest level."""
    front = cut_lineage(tree.filter("parent IS NULL").withColumn("level", F.lit(0)))
    out, level = [], 0
    while not front.isEmpty():
        out.append(front)
        level += 1
        above = front.select("grp", F.col("node").alias("parent"))
        front = cut_lineage(tree.join(above, ["grp", "parent"]).select(*tree.columns).withColumn("level", F.lit(level)))
    return (reduce(DataFrame.unionByName, out) if out else tree.withColumn("level", F.lit(0))), level - 1


def upward(tree: DataFrame, top: int, start: DataFrame, gather: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Values of all nodes: those of leaves in ``start``, and ``gather`` of ``(branch, value)`` rows for their parents."""
    here, out = None, [start]
    for level in range(top, 0, -1):
        at = tree.filter(F.col("level") == level)
        known = start if here is None else start.unionByName(here)
        here = cut_lineage(gather(at.join(known, KEY)))
        out.append(here)
    return reduce(DataFrame.unionByName, out)


def downward(tree: DataFrame, top: int, root: DataFrame, hand: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Values of all nodes: ``root`` has the roots', ``hand(branches of a level, their parents' values as p_*)`` the rest."""
    here, out = cut_lineage(root), [root]
    for level in range(1, top + 1):
        above = here.select(*[F.col(c).alias({"grp": "grp", "node": "parent"}.get(c, f"p_{c}")) for c in here.columns])
        here = cut_lineage(hand(tree.filter(F.col("level") == level), above))
        out.append(here)
    return reduce(DataFrame.unionByName, out)


# ---- parsimony -----------------------------------------------------------------------------------

def dollo(tree: DataFrame, present: DataFrame) -> DataFrame:
    """``(grp, node, gain, loss)`` under Dollo parsimony: every site of ``present`` rows ``(grp, node, site)`` arises once.

    Upward a node learns how many of its children have the site below them; downward
    the site arises at the first node with two such children (or the leaf), and is
    lost where a branch under it has none.
    """
    tree, top = levelled(tree)
    start = present.select("grp", "node", "site").distinct().withColumn("stat", F.lit(1).cast("long"))
    stat = cut_lineage(upward(tree, top, start, lambda d: d.groupBy("grp", F.col("parent").alias("node"), "site").agg(F.count("*").alias("stat"))))

    def judged(d: DataFrame, flag: Column) -> DataFrame:
        gain = ~flag & ((F.col("stat") >= 2) | ((F.col("ndesc") == 1) & (F.col("stat") == 1)))
        loss = flag & (F.col("stat") == 0)
        return d.select("grp", "node", "site", gain.cast("long").alias("gain"), loss.cast("long").alias("loss"), ((flag | gain) & ~loss).alias("flag"), "stat")

    first = judged(tree.filter("level = 0").join(stat, KEY), F.lit(False))

    def hand(at: DataFrame, above: DataFrame) -> DataFrame:
        live = at.join(above.filter("p_stat > 0").drop("p_gain", "p_loss", "p_stat").withColumnRenamed("p_site", "site"), ["grp", "parent"])
        met = live.join(stat, [*KEY, "site"], "left").fillna(0, ["stat"])
        return judged(met, F.col("p_flag")).filter("flag OR stat > 0 OR loss > 0")

    events = downward(tree, top, first, hand).groupBy(*KEY).agg(F.sum("gain").alias("gain"), F.sum("loss").alias("loss"))
    return tree.select(*KEY).join(events, KEY, "left").fillna(0, ["gain", "loss"])


# ---- weights -------------------------------------------------------------------------------------

def resistances(tree: DataFrame, top: int) -> DataFrame:
    """``(grp, node, res)``: resistance between a node and its leaves joined together."""
    start = tree.filter("ndesc = 1").select(*KEY, F.lit(0.0).alias("res"))
    r = F.col("res") + F.col("length")
    both = F.when((F.min(r) > 0) & (F.count("*") > 1), F.min(r) * F.max(r) / (F.min(r) + F.max(r))).otherwise(F.lit(0.0))
    return upward(tree, top, start, lambda d: d.groupBy("grp", F.col("parent").alias("node")).agg(both.alias("res")))


def pair_weights(tree: DataFrame, uniform: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Three-way weights: ``(grp, node, weight)`` of leaves and ``(grp, node, vol)`` of inner nodes of a binary tree.

    At every inner node three directions meet: two children and the rest of the tree,
    each with its resistance.  The weight of a pair is the product of its leaves'
    weights over the square of ``vol`` at their common ancestor; ``uniform`` is added
    to every leaf, shared by the number of leaves.
    """
    tree, top = levelled(tree)
    res = cut_lineage(resistances(tree, top))
    arm = tree.filter("parent IS NOT NULL").join(res, KEY).select("grp", F.col("parent").alias("node"), F.col("node").alias("child"), (F.col("res") + F.col("length")).alias("arm"))
    two = arm.groupBy(*KEY).agg(F.sum("arm").alias("arms"))
    # each child with its own arm a and its sister's b
    sides = cut_lineage(arm.join(two, KEY).select("grp", F.col("child").alias("node"), F.col("arm").alias("a"), (F.col("arms") - F.col("arm")).alias("b")))

    def shared(d: DataFrame, a: Column, b: Column, ros: Column, c: Column) -> DataFrame:
        """Conductances between the three directions as ``wab wac wbc``, and the resistance of the other two seen from a as ``other``."""
        d = d.withColumn("a1", F.when(a <= 0, F.lit(TINY)).when(b <= 0, a + b).otherwise(a)).withColumn("b1", F.when(a <= 0, b + a).when(b <= 0, F.lit(TINY)).otherwise(b))
        d = d.withColumn("r1", ros).withColumn("c1", c).withColumn("flat", (ros <= TINY) | (a + b <= TINY))
        d = d.withColumn("both", F.expr("a1 * b1 / (a1 + b1)")).withColumn("whole", F.expr("a1 * b1 + a1 * c1 + b1 * c1"))
        return d.withColumns({
            "wbc": F.expr("(a1 * b1 + a1 * c1) / (whole * (1 + b1 * r1 / ((both + c1) * (b1 + c1))))"),
            "wac": F.expr("(a1 * b1 + b1 * c1) / (whole * (1 + a1 * r1 / ((both + c1) * (a1 + c1))))"),
            "wab": F.expr("(a1 + b1) * c1 / whole"), "other": F.expr("b1 * r1 / (b1 + r1)"),
        })

    # an inner node's own factor needs its children's arms
    mine = cut_lineage(sides.join(tree.select(*KEY, "parent"), KEY).groupBy("grp", F.col("parent").alias("node")).agg(F.min(F.struct("a", "b")).alias("x")).select(*KEY, F.col("x.a").alias("oa"), F.col("x.b").alias("ob")))

    def hand(at: DataFrame, above: DataFrame) -> DataFrame:
        d = at.join(above, ["grp", "parent"]).join(sides, KEY).join(mine, KEY, "left")
        d = shared(d, F.col("a"), F.col("b"), F.col("p_ros"), F.col("p_length") + F.col("p_ros"))
        first = F.col("p_ros").isNull()
        d = d.select(*KEY, "length", "ndesc", "total", "oa", "ob", "p_vol",
                     F.when(first, F.lit(1.0)).when(F.col("flat"), F.lit(0.5)).otherwise(F.sqrt(F.expr("wab * wac / wbc"))).alias("cur"),
                     F.when(first, F.col("b")).when(F.col("flat"), F.lit(0.0)).otherwise(F.col("other")).alias("ros"))
        d = shared(d, F.col("oa"), F.col("ob"), F.col("ros"), F.col("length") + F.col("ros"))
        own = F.when(F.col("oa").isNull() | F.col("flat"), F.lit(1.0)).otherwise(F.sqrt(F.expr("wac * wbc / wab")))
        return d.select(*KEY, "length", "ros", (F.col("cur") * own * F.col("p_vol")).alias("vol"), "ndesc", "total")

    total = tree.filter("level = 0").select("grp", F.col("ndesc").alias("total"))
    tree = cut_lineage(tree.join(total, "grp"))
    root = tree.filter("level = 0").select(*KEY, F.lit(0.0).alias("length"), F.lit(None).cast("double").alias("ros"), F.lit(1.0).alias("vol"), "ndesc", "total")
    vol = cut_lineage(downward(tree, top, root, hand))
    leaf = vol.filter("ndesc = 1").select(*KEY, (F.col("vol") + uniform / F.col("total")).alias("weight"))
    return leaf, vol.filter("ndesc > 1").select(*KEY, "vol")


def leaf_pair_weights(tree: DataFrame, memberships: DataFrame, uniform: float = 0.0) -> DataFrame:
    """``(grp, i, j, weight)`` of all pairs of leaves of each tree, met at their common ancestor."""
    leaf, vol = pair_weights(tree, uniform)
    m = memberships.join(leaf.withColumnRenamed("node", "leaf"), ["grp", "leaf"])
    a = m.filter("side = 0").select(*KEY, F.col("leaf").alias("x"), F.col("weight").alias("wx"))
    b = m.filter("side = 1").select(*KEY, F.col("leaf").alias("y"), F.col("weight").alias("wy"))
    w = F.col("wx") * F.col("wy") / (F.col("vol") * F.col("vol"))
    return a.join(b, KEY).join(vol, KEY).select("grp", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), w.alias("weight"))


# ---- rooting -------------------------------------------------------------------------------------

def reroot(tree: DataFrame, cut: DataFrame) -> DataFrame:
    """Branches ``(grp, node, parent, length)`` of trees rooted anew inside the branch over ``node``, ``below`` from it.

    ``cut`` has one row ``(grp, node, below)`` for each group.  The new root is -1;
    pointers turn along the path to the old one, and an old root that is left with one
    branch and is no leaf goes.
    """
    up = cut_lineage(tree.select("grp", "node", "parent", "length"))
    leaf = up.join(up.select("grp", F.col("parent").alias("node")).distinct(), KEY, "left_anti").select(*KEY)
    front = cut_lineage(cut.join(up, KEY))
    split = front.select("grp", F.explode(F.array(
        F.struct("node", F.col("below").alias("length")), F.struct(F.col("parent").alias("node"), (F.col("length") - F.col("below")).alias("length")))).alias("x"))
    turned = [split.select("grp", "x.node", F.lit(-1).cast("long").alias("parent"), "x.length")]
    path, step = [front.select(*KEY)], front
    while True:
        step = cut_lineage(step.select("grp", F.col("parent").alias("node")).join(up, KEY).select(*KEY, "parent", "length"))
        path.append(step.select(*KEY))
        step = step.filter("parent IS NOT NULL")
        if step.isEmpty():
            break
        turned.append(step.select("grp", F.col("parent").alias("node"), F.col("node").alias("parent"), "length"))
    kept = up.join(reduce(DataFrame.unionByName, path), KEY, "left_anti")
    none = F.lit(None)
    new = reduce(DataFrame.unionByName, turned, kept).unionByName(cut.select("grp", F.lit(-1).cast("long").alias("node"), none.cast("long").alias("parent"), none.cast("double").alias("length")))
    new = cut_lineage(new)
    single = new.groupBy("grp", F.col("parent").alias("node")).agg(F.count("*").alias("n")).filter("n = 1").select(*KEY)
    old = tree.filter("parent IS NULL").select(*KEY).join(leaf, KEY, "left_anti")
    gone = new.join(single.join(old, KEY, "left_semi"), KEY).select("grp", F.col("node").alias("parent"), F.col("parent").alias("q"), F.col("length").alias("more"))
    d = new.join(gone.select("grp", F.col("parent").alias("node")), KEY, "left_anti").join(gone, ["grp", "parent"], "left")
    length = F.when(F.col("more").isNotNull(), F.col("length") + F.col("more")).otherwise(F.col("length"))
    return d.select("grp", "node", F.coalesce("q", "parent").alias("parent"), length.alias("length"))


def centres(tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """``(grp, node, below)``: the middle of each tree's longest path between leaves (of equal ones the smallest leaves).

    One sweep up keeps the farthest leaf of every branch; the two best branches of a
    node make the longest path over it; the ends of the best one walk up to its middle.
    """
    tree, top = levelled(tree)
    far = lambda d, leaf: F.struct(F.round(d, 9).alias("r"), (-leaf).alias("m"), d.alias("d"), leaf.alias("leaf"))
    start = leaves.select("grp", F.col("node").cast("long").alias("node")).select(*KEY, far(F.lit(0.0), F.col("node")).alias("x"))
    inner = start.join(tree.filter("level = 0").select(*KEY), KEY, "left_semi")  # a root that is a leaf itself
    arms: list[DataFrame] = [inner]

    def gather(d: DataFrame) -> DataFrame:
        arm = cut_lineage(d.select("grp", F.col("parent").alias("node"), far(F.col("x.d") + F.col("length"), F.col("x.leaf")).alias("x")))
        arms.append(arm)
        return arm.groupBy(*KEY).agg(F.max("x").alias("x"))

    upward(tree, top, start, gather)
    best = reduce(DataFrame.unionByName, arms).groupBy(*KEY).agg(F.reverse(F.array_sort(F.collect_list("x"))).alias("x")).filter("size(x) > 1")  # a node's branches
    a, b = F.col("x")[0], F.col("x")[1]
    low = F.least(a["leaf"], b["leaf"])
    path = best.select("grp", (a["d"] + b["d"]).alias("whole"), low.alias("a"), F.greatest(a["leaf"], b["leaf"]).alias("b"), F.col("node").alias("over"))
    pick = F.max(F.struct(F.round("whole", 9).alias("r"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), "whole", "a", "b", "over")).alias("p")
    path = cut_lineage(path.groupBy("grp").agg(pick).select("grp", "p.whole", "p.a", "p.b", "p.over"))
    step = path.select("grp", "whole", "over", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node")))).alias("e"), F.lit(0.0).alias("dist"))
    step, found = step.select("grp", "whole", "over", "e.side", "e.node", "dist"), []
    for _ in range(top):
        step = cut_lineage(step.join(tree.select(*KEY, "parent", "length"), KEY).filter("node <> over"))
        half = F.round(F.col("whole") / 2 - F.col("dist"), 9)
        here = F.when(F.col("side") == 0, (half >= 0) & (half < F.round("length", 9))).otherwise((half > 0) & (half <= F.round("length", 9)))
        found.append(step.filter(here).select("grp", "node", (F.col("whole") / 2 - F.col("dist")).alias("below"), "side"))
        step = step.select("grp", "whole", "over", "side", F.col("parent").alias("node"), (F.col("dist") + F.col("length")).alias("dist"))
    if not found:
        return path.select("grp", F.col("a").alias("node"), F.col("whole").alias("below")).limit(0)
    return reduce(DataFrame.unionByName, found).groupBy("grp").agg(F.min(F.struct("side", "node", "below")).alias("x")).select("grp", "x.node", "x.below")


def balance_points(tree: DataFrame) -> DataFrame:
    """``(grp, node, below)``: the middle of the branch that halves the leaves best (of equal ones the smallest node)."""
    total = tree.filter("parent IS NULL").select("grp", F.col("ndesc").alias("total"))
    d = tree.filter("parent IS NOT NULL").join(total, "grp")
    key = F.struct(F.abs(F.col("total") - 2 * F.col("ndesc")).alias("k"), "node", "length")
    return d.groupBy("grp").agg(F.min(key).alias("x")).select("grp", "x.node", (F.col("x.length") / 2).alias("below"))


# ---- division ------------------------------------------------------------------------------------

def divide(nodes: DataFrame, leaves: DataFrame, least: int, most: int) -> DataFrame:
    """``(grp, node, part, size, outlier)``: whole subtrees of a dendrogram dealt into parts of about ``most`` leaves.

    All trees go down one level a round.  A part up to ``most`` leaves is done (an
    outlier if it has ``least`` or fewer).  Where the smaller child has more than
    ``least`` leaves the part splits; else, as long as the larger child is still
    larger than ``most``, the smaller one is grafted on the larger one's smaller child.
    """
    one = leaves.select("grp", F.col("node").cast("long").alias("node"), F.lit(1).cast("long").alias("ndesc"))
    size = nodes.select("grp", "node", "ndesc").unionByName(one)
    kid = lambda c: size.select("grp", F.col("node").alias(c), F.col("ndesc").alias(f"n_{c}"))
    inner = nodes.select("grp", "node", "left", "right").join(kid("left"), ["grp", "left"]).join(kid("right"), ["grp", "right"])
    swap = (F.col("n_right") > F.col("n_left")) | ((F.col("n_right") == F.col("n_left")) & (F.col("right") < F.col("left")))
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    inner = cut_lineage(inner.select("grp", "node", pick("left", "right").alias("c"), pick("n_left", "n_right").alias("nc"), pick("right", "left").alias("d"), pick("n_right", "n_left").alias("nd")))
    child = nodes.select("grp", F.explode(F.array("left", "right")).alias("node"))
    state = size.join(child, KEY, "left_anti").select("grp", "node", F.col("node").alias("part"), F.col("ndesc").alias("n"), F.lit(0).cast("long").alias("e"))
    carried, out = None, []  # subtrees that were grafted on a part
    while True:
        met = state.join(inner, KEY, "left")
        free = F.col("e") == 0
        small = F.when(free, F.col("nd")).otherwise(F.least("nc", F.col("nd") + F.col("e")))
        done = (F.col("n") + F.col("e") <= most) | (F.col("n") <= most)
        split = ~done & (small > least)
        stay = ~done & ~split & ((F.col("nc") <= most) | (~free & (F.col("nc") <= F.col("nd") + F.col("e"))))
        met = cut_lineage(met.withColumn("act", F.when(done | stay, 0).when(split, 1).otherwise(2)))
        out.append(met.filter("act = 0").select("grp", "node", "part"))
        # of a split the larger child is a part of its own; what was grafted stays with the smaller one
        new = F.when(F.col("act") == 1, F.array(F.struct(F.col("c").alias("node"), F.col("c").alias("part"), F.col("nc").alias("n"), F.lit(0).cast("long").alias("e")),
                                               F.struct(F.col("d").alias("node"), F.when(free, F.col("d")).otherwise(F.col("part")).alias("part"), F.col("nd").alias("n"), F.col("e").alias("e"))))
        new = new.otherwise(F.array(F.struct(F.col("c").alias("node"), F.col("part").alias("part"), F.col("nc").alias("n"), (F.col("e") + F.col("nd")).alias("e"))))
        grafted = met.filter("act = 2").select("grp", F.col("d").alias("node"), "part")
        carried = grafted if carried is None else carried.unionByName(grafted)
        state = cut_lineage(met.filter("act > 0").select("grp", F.explode(new).alias("x")).select("grp", "x.*"))
        if state.isEmpty():
            break
    whole = cut_lineage(reduce(DataFrame.unionByName, out).unionByName(carried).join(size, KEY))
    total = whole.groupBy("grp", "part").agg(F.sum("ndesc").alias("size"))
    return whole.join(total, ["grp", "part"]).select("grp", "node", "part", "size", (F.col("size") <= least).alias("outlier"))


def prune(nodes: DataFrame, leaves: DataFrame, height: float, least: int) -> DataFrame:
    """``(grp, node, kept)``: small loose trees come apart, their single leaves become outsiders (not kept).

    A subtree stays if it has ``least`` leaves or more, or joins at ``height * (1 - 1 / leaves)`` or below.
    """
    one = leaves.select("grp", F.col("node").cast("long").alias("node"), F.lit(1).cast("long").alias("ndesc"), F.lit(0.0).alias("height"), *[F.lit(None).cast("long").alias(c) for c in ("left", "right")])
    tree = cut_lineage(nodes.select(*one.columns).unionByName(one))
    child = nodes.select("grp", F.explode(F.array("left", "right")).alias("node"))
    front, out = tree.join(child, KEY, "left_anti"), []
    while True:
        leaf, n = F.col("left").isNull(), F.col("ndesc")
        keep = (n >= least) | (~leaf & (F.col("height") <= height * (1 - 1 / n)))
        front = cut_lineage(front.withColumn("kept", keep))
        out.append(front.filter(F.col("kept") | leaf).select("grp", "node", "kept"))
        next_ = front.filter(~F.col("kept") & ~leaf).select("grp", F.explode(F.array("left", "right")).alias("node"))
        front = cut_lineage(next_.join(tree, KEY))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, out)
