"""Substitution scores from aligned letters: mutation matrices, their powers, log-odds.

Counts of letter pairs give the chance that a letter changes to another, scaled to
``rate`` changes a letter; the matrix is squared until it stands for ``2 ** doublings``
steps, and a score is ten times the decimal logarithm of how much more often a pair is
met than by chance.  All tables have a row per pair of letters, so at most 26 x 26.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut_lineage


def pair_counts(pairs: DataFrame) -> DataFrame:
    """``(x, y, n)`` of letters that stand over each other in rows ``a1``, ``a2``, counted both ways; gaps are left out."""
    both = F.arrays_zip(F.split("a1", "").alias("x"), F.split("a2", "").alias("y"))
    d = pairs.select(F.explode(both).alias("z")).select("z.x", "z.y").filter("x RLIKE '^[A-Z]$' AND y RLIKE '^[A-Z]$'")
    n = d.groupBy("x", "y").agg(F.count("*").alias("n"))
    return n.unionByName(n.select(F.col("y").alias("x"), F.col("x").alias("y"), "n")).groupBy("x", "y").agg(F.sum("n").alias("n"))


def mutation_matrix(counts: DataFrame, rate: float = 0.01) -> DataFrame:
    """``(old, new, p, f)``: chance of ``new`` in place of ``old`` in one step, and the frequency of ``new``."""
    size = counts.groupBy("x").agg(F.sum("n").alias("nx"), F.sum(F.when(F.col("x") != F.col("y"), F.col("n")).otherwise(0)).alias("moved"))
    whole = size.agg(F.sum("nx").alias("whole"), F.sum("moved").alias("all_moved"))
    size = cut_lineage(size.join(F.broadcast(whole)))  # one row
    grid = size.select(F.col("x").alias("old"), "nx", "moved", F.when(F.col("all_moved") > 0, rate * F.col("whole") / F.col("all_moved")).otherwise(0.0).alias("scale")).join(
        F.broadcast(size.select(F.col("x").alias("new"), (F.col("nx") / F.col("whole")).alias("f"))))  # letters by letters
    d = grid.join(counts.select(F.col("x").alias("old"), F.col("y").alias("new"), "n"), ["old", "new"], "left").fillna(0, ["n"])
    p = F.when(F.col("old") == F.col("new"), 1 - F.col("scale") * F.col("moved") / F.col("nx")).otherwise(F.col("scale") * F.col("n") / F.col("nx"))
    return d.select("old", "new", p.alias("p"), "f")


def squared(matrix: DataFrame) -> DataFrame:
    a = matrix.select("old", F.col("new").alias("mid"), "p")
    b = matrix.select(F.col("old").alias("mid"), "new", F.col("p").alias("q"), "f")
    return cut_lineage(a.join(b, "mid").groupBy("old", "new").agg(F.sum(F.col("p") * F.col("q")).alias("p"), F.first("f").alias("f")))


def log_odds(counts: DataFrame, doublings: int, rate: float = 0.01) -> DataFrame:
    """``(old, new, p, score)`` after ``2 ** doublings`` steps; pairs that can't be reached have no score."""
    m = cut_lineage(mutation_matrix(counts, rate))
    for _ in range(doublings):
        m = squared(m)
    return m.select("old", "new", "p", F.when(F.col("p") > 0, 10 * F.log10(F.col("p") / F.col("f"))).alias("score"))


def as_array(scores: DataFrame, missing: float) -> np.ndarray:
    """26 x 26 scores for the alignment kernels; ``missing`` for letters that don't occur."""
    out = np.full((26, 26), float(missing))
    for r in scores.collect():
        if r["score"] is not None:
            out[ord(r["old"]) - 65, ord(r["new"]) - 65] = r["score"]
    return out
