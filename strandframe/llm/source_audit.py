"""Divergence of the sources of a language, term by term, by sparse merges of pairs of groups.

Every task counts terms per (language, source) before anything is shuffled.  A
language keeps the terms of ``least_docs`` or more of its documents; kept terms
get dense ids inside blocks of bounded size, and each group becomes one sorted
array of ``(id, count)`` per block.  The arrays of two groups meet in the task of
their unordered pair and block: a galloping intersection finds the common ids, and
overlaps, terms of one side only and absent ones are priced in both directions.
Terms that neither side has cost the same each, so they are added by their number.

Shares and prices are whole numbers: ``p = 1 + floor(SCALE * (count + 1) / (N + V))``
and ``floor((p - q)^2 / q)``.  Division in steps of a thousand keeps every product
within 64 bits for counts below 9.2e15.

Defined results: null text, language and source are empty; repeated rows are
documents of their own; a group without terms has N = 0 and is priced like any
other; a language that keeps no term has pairs of value 0 and no term rows; a
language of one source has no pair rows; an empty table has no rows.  A block of a
group is at most a few times ``block`` entries, whatever the source holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandframe.session import cut_lineage

SCALE = 1_000_000_000
#: Distinct (group, term) counts that a task holds before it hands them on.
HELD = 400_000
#: Bytes that are no letters become spaces, A-Z become a-z; the bytes of other characters stay.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MADE = "lang string, source string, term string, n long, docs long"


def terms(text: str) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(TERMS).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for key, c in count.items():
            d = docs[key]
            names = [None, *(t.decode() for t in c)]  # the null term says that the group occurs
            cols = [[key[0]] * len(names), [key[1]] * len(names), names, [0, *c.values()], [0, *(d[t] for t in c)]]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["lang", "source", "term", "n", "docs"])
        count.clear()
        docs.clear()

    held = 0
    for b in batches:
        lang, source, text = (b.column(i) for i in range(3))
        for i in range(b.num_rows):
            key = (lang[i].as_py(), source[i].as_py())
            if key not in count:
                count[key], docs[key] = Counter(), Counter()
            words = terms(text[i].as_py())
            before = len(count[key])
            count[key].update(words)
            docs[key].update(set(words))
            held += len(count[key]) - before
            if held > HELD:
                yield from out()
                held = 0
    yield from out()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``; the row with a null term stands for the group itself."""
    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return rows.mapInArrow(_counted, MADE).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, whole: Column) -> Column:
    """``1 + floor(SCALE * (n + 1) / whole)`` by long division in base 1000."""
    rest, made = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        made, rest = made * 1000 + F.call_function("div", rest, whole), rest % whole
    return made + 1


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """``share`` for an array."""
    rest, made = n + 1, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        made, rest = made * 1000 + rest // whole, rest % whole
    return made + 1


def prices(p: np.ndarray | int, q: np.ndarray | int) -> int:
    return int(np.sum((p - q) * (p - q) // q))


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Positions in ``long`` of the ids of ``short`` (both sorted, distinct), or -1: all needles double their steps together.

    A needle starts at the run of 64 ids that may hold it and gallops inside it.
    """
    if not len(long) or not len(short):
        return np.full(len(short), -1)
    low = 64 * (np.searchsorted(long[::64], short, "right") - 1)
    at, low = np.maximum(low, 0), low
    for step in (32, 16, 8, 4, 2, 1):
        ahead = at + step
        ok = (ahead < len(long)) & (long[np.minimum(ahead, len(long) - 1)] <= short)
        at = np.where(ok, ahead, at)
    return np.where((low >= 0) & (long[at] == short), at, -1)


def merged(ia: np.ndarray, na: np.ndarray, ib: np.ndarray, nb: np.ndarray, whole_a: int, whole_b: int) -> tuple[int, int, int]:
    """Price of a against b, of b against a, and the number of ids that either has."""
    pa_, pb = shares(na, whole_a), shares(nb, whole_b)
    zero = np.zeros(1, np.int64)
    a0, b0 = int(shares(zero, whole_a)[0]), int(shares(zero, whole_b)[0])
    if len(ia) <= len(ib):
        at = gallop(ia, ib)
        both_a, both_b = np.flatnonzero(at >= 0), at[at >= 0]
    else:
        at = gallop(ib, ia)
        both_b, both_a = np.flatnonzero(at >= 0), at[at >= 0]
    x, y = pa_[both_a], pb[both_b]
    only_a, only_b = np.delete(pa_, both_a), np.delete(pb, both_b)
    there = prices(x, y) + prices(only_a, b0) + prices(a0, only_b)
    back = prices(y, x) + prices(b0, only_a) + prices(only_b, a0)
    return there, back, len(ia) + len(ib) - len(x)


PAIRED = "lang string, a string, b string, there long, back long, n long"


def _pair(key, left: pa.Table, right: pa.Table) -> pa.Table:
    right = right.rename_columns(left.column_names)
    one = left if left.num_rows else right
    lang, a, b, whole_a, whole_b = (one.column(c)[0].as_py() for c in ("lang", "a", "b", "whole_a", "whole_b"))
    none = np.zeros(0, np.int64)
    sides = [[t.column(c)[0].values.to_numpy() for c in ("ids", "counts")] if t.num_rows else [none, none] for t in (left, right)]
    there, back, n = merged(*sides[0], *sides[1], whole_a, whole_b)
    return pa.table([pa.array([x]) for x in (lang, a, b, there, back, n)], names=["lang", "a", "b", "there", "back", "n"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, block: int = 50_000) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: other sources by divergence, and the ``top`` terms above the language's share."""
    counts = cut_lineage(term_counts(docs, text, lang, source))
    seen = counts.filter("term IS NOT NULL")
    kept = seen.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = cut_lineage(kept)
    blocks = kept.count() // block + 1
    number = F.row_number().over(W.partitionBy("lang", "block").orderBy("term")).cast("long")  # a block holds about ``block`` terms at most
    ids = kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks))).withColumn("id", number)
    of_lang = kept.groupBy("lang").agg(F.sum("total").alias("nl"), F.count("*").alias("v"))
    entries = cut_lineage(seen.select("lang", "source", "term", "n").join(ids, ["lang", "term"]))
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("ng"))
    groups = counts.filter("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    v = F.coalesce("v", F.lit(0))
    groups = cut_lineage(groups.select("lang", "source", v.alias("v"), (F.coalesce("ng", F.lit(0)) + v).alias("whole"), (F.coalesce("nl", F.lit(0)) + v).alias("whole_lang")))
    return term_part(entries, groups, top).unionByName(pair_part(entries, groups))


def term_part(entries: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    priced = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("whole"))).withColumn("q", share(F.col("total"), F.col("whole_lang"))).filter("p > q")
    rows = priced.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def pair_part(entries: DataFrame, groups: DataFrame) -> DataFrame:
    sets = entries.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("x"))
    sets = sets.select("lang", "source", "block", F.col("x.id").alias("ids"), F.col("x.n").alias("counts"))
    a = groups.select("lang", F.col("source").alias("a"), F.col("whole").alias("whole_a"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("whole").alias("whole_b"))
    pairs = a.join(b, "lang").filter("a < b")  # as many as the result has rows
    key = ["lang", "a", "b", "block"]
    left = pairs.drop("v").join(sets.withColumnRenamed("source", "a"), ["lang", "a"])
    right = pairs.drop("v").join(sets.withColumnRenamed("source", "b"), ["lang", "b"])
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in left.columns])  # names of its own: both sides come from one table
    met = left.groupBy(*key).cogroup(right.groupBy(*[f"r_{c}" for c in key])).applyInArrow(_pair, PAIRED)
    met = met.groupBy("lang", "a", "b").agg(F.sum("there").alias("there"), F.sum("back").alias("back"), F.sum("n").alias("n"))
    zero = F.lit(0).cast("long")
    all_ = pairs.join(met, ["lang", "a", "b"], "left").fillna(0, ["there", "back", "n"])
    # no kept term: whole_a and whole_b are 0, nothing is priced
    a0, b0 = (share(zero, F.greatest(F.col(c), F.lit(1))) for c in ("whole_a", "whole_b"))
    rest = F.col("v") - F.col("n")
    both = all_.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item"), (F.col("there") + rest * price(a0, b0)).alias("value")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item"), (F.col("back") + rest * price(b0, a0)).alias("value")))).alias("r"))
    rows = both.select("lang", "r.source", F.lit("pair").alias("part"), "r.item", "r.value")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
