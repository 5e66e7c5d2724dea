"""Pattern search: every hit position, overlapping ones included."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions import residues as R


def word_hits(words: list[str]) -> Column:
    """Array of struct(i, w): 0-based positions of any of ``words``, all of one length."""
    k = len(words[0])
    places = F.transform(R.kmers("s", k), lambda w, i: F.when(w.isin(*words), F.concat_ws(":", i.cast("string"), w)))
    hits = F.filter(places, lambda x: x.isNotNull())
    return F.transform(
        hits, lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("i"), F.split(x, ":")[1].alias("w"))
    )


def find_any(df: DataFrame, patterns: list[str]) -> DataFrame:
    """Positions (1-based) of several literal patterns: ``(seq_id, pos, hit)``."""
    by_length = [word_hits([p for p in patterns if len(p) == k]) for k in sorted({len(p) for p in patterns})]
    hits = by_length[0] if len(by_length) == 1 else F.concat(*by_length)
    return df.select("seq_id", F.inline(hits).alias("i", "hit")).select("seq_id", (F.col("i") + 1).alias("pos"), "hit")


def expand(pattern: str) -> list[str]:
    """All unambiguous words of an IUPAC pattern."""
    bases = []
    for ch in pattern:
        mask = R.IUPAC.index("T" if ch == "U" else ch) + 1
        bases.append([b for bit, b in ((1, "A"), (2, "C"), (4, "G"), (8, "T")) if mask & bit])
    return ["".join(p) for p in product(*bases)]


def restriction_sites(df: DataFrame, enzymes: list[tuple[str, str, int]]) -> DataFrame:
    """Recognition sites on both strands (once when palindromic) with cut positions.

    Ambiguous sites are expanded to words, each sequence is scanned once per
    site length, and only the hits are exploded and joined with the enzymes.
    """
    table = []
    for name, site, cut in enzymes:
        other = site.translate(str.maketrans(R.COMPLEMENT_FROM, R.COMPLEMENT_TO))[::-1]
        for strand, pattern in [("+", site)] + ([("-", other)] if other != site else []):
            table += [(w, name, strand, cut) for w in expand(pattern)]
    lookup = df.sparkSession.createDataFrame(table, "hit string, enzyme string, strand string, cut int")
    hits = find_any(df, sorted({w for w, *_ in table}))
    return hits.join(F.broadcast(lookup), "hit").select("seq_id", "enzyme", "strand", "pos", (F.col("pos") + F.col("cut") - 1).alias("cut"))
