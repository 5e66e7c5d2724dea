"""Readers of distance matrices, edge lists, trees and catalogs as text rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


def distance_matrices(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Parse ``names / blank line / lower triangle`` texts to ``(ident, i, j, name_i, name_j, d)``, i < j."""
    halves = F.split(col_text(text), r"\n\s*\n")
    names = F.filter(F.split(halves[0], r"\s+"), lambda x: x != "")
    rows = F.filter(F.split(halves[1], r"\n"), lambda x: F.trim(x) != "")
    d = df.select(ident, names.alias("names"), F.posexplode(rows).alias("k", "line"))
    d = d.select(ident, "names", "k", F.posexplode(F.split(F.trim("line"), r"\s+")).alias("i", "d"))
    return d.select(
        ident, "i", (F.col("k") + 1).alias("j"), F.col("names")[F.col("i")].alias("name_i"), F.col("names")[F.col("k") + 1].alias("name_j"),
        F.col("d").cast("double").alias("d"),
    )


def col_text(c):
    return F.trim(F.col(c) if isinstance(c, str) else c)


def edges_from_text(df: DataFrame, text: str, column: int) -> DataFrame:
    """Whitespace separated lines: the last two fields are vertex names, field ``column`` (from 1) the value."""
    f = F.split(F.trim(text), r"\s+")
    ok = df.filter(~F.col(text).startswith(">")).select(f.alias("f")).filter(F.size("f") >= 3)
    return ok.select(
        F.element_at("f", -2).alias("u"), F.element_at("f", -1).alias("v"), F.element_at("f", column).cast("double").alias("value")
    )


def catalog_entries(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Lines of a catalog with their group: blank lines separate groups, ``;`` lines are comments."""
    lines = df.select(ident, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    blank = (F.trim("line") == "").cast("int")
    w = W.partitionBy(ident).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)  # one text
    d = lines.withColumn("grp", F.sum(blank).over(w) + 1)
    return d.filter((F.trim("line") != "") & ~F.col("line").startswith(";")).select(ident, "line_no", "grp", "line")


def newick_nodes(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Nodes of Newick trees: ``(ident, node, parent, name, length)``; one row's text is one tree."""
    import re

    token = re.compile(r"[(),;]|:[^(),;]+|[^(),:;]+")

    def parse(batches):
        for pdf in batches:
            out = []
            for key, tree in zip(pdf[ident], pdf[text]):
                nodes, stack, current, fresh = [], [], None, 0
                for tok in token.findall(tree):
                    if tok == "(":
                        nodes.append([key, fresh, stack[-1] if stack else None, None, None])
                        stack.append(fresh)
                        fresh, current = fresh + 1, None
                    elif tok == ")":
                        current = stack.pop()
                    elif tok.startswith(":"):
                        nodes[current][4] = float(tok[1:])
                    elif tok in ",;":
                        current = None
                    elif current is not None:
                        nodes[current][3] = tok.strip()
                    else:
                        nodes.append([key, fresh, stack[-1] if stack else None, tok.strip(), None])
                        current, fresh = fresh, fresh + 1
                out += nodes
            yield pd.DataFrame(out, columns=[ident, "node", "parent", "name", "length"]).astype({"parent": "Int64", "node": "Int64"})

    kind = dict(df.dtypes)[ident]
    return df.select(ident, text).mapInPandas(parse, f"{ident} {kind}, node long, parent long, name string, length double")
