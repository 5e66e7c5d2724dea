"""Benchmark decontamination by a prefix-filtered set join with exact verification.

An item's windows (``size`` consecutive words, or the whole of a shorter item)
are sets of word shingles.  A document that holds a window holds all its
shingles, so the rarest one is a sufficient prefix: shingles are ordered by their
number of occurrences in all documents, only each window's first one is looked
for, and windows with a shingle that occurs nowhere fall away.  A place where a
prefix occurs meets the windows behind it in a join; length and positional
bounds (the window must lie inside the document) come first, then the document's
words over the item-sized window are compared with the item's.

Documents are scanned where they lie.  The shingles looked for go to the tasks in
blocks of at most about ``BLOCK``, one scan per block, so their number is not
bounded by memory; a place carries just the words around it.

Defined results: a null or empty text has no words; an item without words has no
window; rows with one item id count as one item, a null id as the item ``null``;
every document row has a result of its own, repeated ids too; without documents
there are no rows, without items no document is hit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.llm.batches import packed, schema, text_slices
from strandframe.session import cut_lineage

#: Shingles that a scan looks for at once.
BLOCK = 200_000
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of words stay, A-Z in lower case; all others become a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def words_column(text: str) -> Column:
    """The same words as a column expression."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOW), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def windows(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """``(item, words, len)`` of every distinct window of every item."""
    w = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), words_column(text).alias("w")).filter("size(w) > 0")
    n = F.least(F.lit(size), F.size("w"))
    starts = w.select("item", "w", n.alias("len"), F.explode(F.sequence(F.lit(1), F.size("w") - n + 1)).alias("i"))
    return starts.select("item", F.expr("array_join(slice(w, i, len), ' ')").alias("words"), "len").distinct()


def shingles(win: DataFrame, width: int) -> DataFrame:
    """``(words, len, shingle, off)`` of every distinct window, with the shingle's first place in it."""
    d = win.select("words", "len").distinct().select("words", "len", F.split("words", " ").alias("w"))
    k = F.least(F.lit(width), F.col("len"))
    each = d.select("words", "len", "w", k.alias("k"), F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
    s = each.select("words", "len", F.expr("array_join(slice(w, off + 1, k), ' ')").alias("shingle"), "off")
    return s.groupBy("words", "len", "shingle").agg(F.min("off").alias("off"))


class Finder:
    """Places of known shingles in lists of words."""

    def __init__(self, known: list[bytes]):
        self.known = set(known)
        self.vocabulary = {w for s in known for w in s.split(b" ")}
        self.widths = sorted({s.count(b" ") + 1 for s in known})

    def places(self, words: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
        """``(place, width, shingle)``; an empty word separates texts."""
        inside = np.fromiter(map(self.vocabulary.__contains__, words), bool, len(words))
        total = np.concatenate([[0], np.cumsum(inside)])
        for k in self.widths:
            for p in np.flatnonzero(total[k:] - total[:-k] == k).tolist() if len(words) >= k else ():
                if (s := b" ".join(words[p : p + k])) in self.known:
                    yield p, k, s


def _blocks(found: DataFrame) -> Iterator[list[bytes]]:
    """The distinct shingles of a checkpointed table in blocks, each small enough for the driver."""
    distinct = found.select("shingle").distinct()
    n = -(-distinct.count() // BLOCK)
    for b in range(n):
        part = distinct.filter(F.pmod(F.xxhash64("shingle"), F.lit(n)) == b)
        yield [r["shingle"].encode() for r in part.toLocalIterator()]


def occurrences(docs: DataFrame, text: str, found: DataFrame) -> DataFrame:
    """``(shingle, n)``: how often each shingle of ``found`` occurs in all documents; counted in the tasks before the shuffle."""
    sc = docs.sparkSession.sparkContext

    def count(known):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder, seen = Finder(known.value), Counter()
            for b in batches:
                for _, texts in text_slices(b.column(0)):
                    words = [w for t in texts for w in (*words_of(t), b"")]
                    seen.update(s for _, _, s in finder.places(words))
            yield pa.RecordBatch.from_pydict({"shingle": pa.array([s.decode() for s in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        return run

    out = None
    for known in _blocks(found):
        part = docs.select(F.col(text).cast("string")).mapInArrow(count(sc.broadcast(known)), "shingle string, n long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "shingle string, n long")
    return out.groupBy("shingle").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, text: str, keep: tuple[str, ...], prefix: DataFrame, size: int) -> DataFrame:
    """A row ``(row, *keep, n_words)`` per document and one more for each place of a prefix, with the words around it."""
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).cast("string").alias("_text"))
    kept = source.schema.fields[:-1]

    def scan(known, heads: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(known.value)
            for b in batches:
                for first, texts in text_slices(b.column(len(kept))):
                    words, end = [], []
                    for t in texts:
                        words += words_of(t)
                        end.append(len(words))
                        words.append(b"")
                    begin = [0, *(e + 1 for e in end[:-1])]
                    found = list(finder.places(words))
                    doc = np.searchsorted(np.array(end), [p for p, _, _ in found]).tolist()
                    rows, at, left, shingle, around = (list(range(len(texts))) if heads else []), [], [], [], []
                    none = [None] * len(rows)
                    for (p, k, s), d in zip(found, doc):
                        low, high = max(begin[d], p + k - size), min(end[d], p + size)
                        rows.append(d)
                        at.append(p - begin[d])
                        left.append(p - low)
                        shingle.append(s.decode())
                        around.append(b" ".join(words[low:high]).decode())
                    index = pa.array(rows, pa.int64())
                    n_words = pa.array([e - s for s, e in zip(begin, end)], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(i).slice(first, len(texts)).take(index) for i in range(len(kept))]
                        + [n_words.take(index), pa.array(none + at, pa.int64()), pa.array(none + left, pa.int32()), pa.array(none + shingle, pa.string()), pa.array(none + around, pa.string())],
                        names=[*(f.name for f in kept), "_n_words", "_at", "_left", "_shingle", "_around"],
                    )

        return run

    made = schema(kept, "_n_words long, _at long, _left int, _shingle string, _around string")
    out = None
    for known in _blocks(prefix):
        part = source.mapInArrow(scan(sc.broadcast(known), out is None), made)
        out = part if out is None else out.unionByName(part)
    return source.mapInArrow(scan(sc.broadcast([]), True), made) if out is None else out


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", size: int = 10, width: int = 5) -> DataFrame:
    """``keep`` columns with ``n_words``, ``n_hit`` (words inside occurring windows) and ``items`` (their ids, sorted as strings)."""
    if clash := set(keep) & {"n_words", "n_hit", "items"}:
        raise ValueError(f"kept columns clash with made ones: {sorted(clash)}")
    win = cut_lineage(windows(items, item, text, size))
    all_shingles = cut_lineage(shingles(win, width))
    seen = occurrences(docs, text, all_shingles)
    ranked = all_shingles.join(seen, "shingle", "left").groupBy("words", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off")).alias("p"))
    prefix = cut_lineage(ranked.filter("p.n > 0").select("words", "len", "p.shingle", "p.off"))
    kept = docs.select(*keep)
    place = places(docs.select(packed(kept, "_keep"), F.col(text).alias("_body")), "_body", ("_keep",), prefix, size)
    # a document's own row has a key that meets no shingle, so such rows don't gather on one key
    key = F.coalesce("_shingle", F.concat(F.lit(" "), F.col("_row").cast("string")))
    met = place.withColumn("shingle", key).join(prefix, "shingle", "left")
    inside = (F.col("_left") >= F.col("off")) & (F.size(F.split("_around", " ")) - F.col("_left") >= F.col("len") - F.col("off"))
    same = F.expr("array_join(slice(split(_around, ' '), _left - off + 1, len), ' ')") == F.col("words")
    hit = met.withColumn("_hit", F.coalesce(inside & F.when(inside, same), F.lit(False)))
    start = F.when(F.col("_hit"), F.struct((F.col("_at") - F.col("off")).alias("a"), (F.col("_at") - F.col("off") + F.col("len")).alias("b")))
    # a window once for each place; the items that own it come by a join on the window
    owner = win.groupBy("words").agg(F.collect_set("item").alias("owners"))
    spans = hit.select("_row", "_keep", "_n_words", start.alias("span"), F.when(F.col("_hit"), F.col("words")).alias("_window"))
    own_key = F.coalesce("_window", F.concat(F.lit(" "), F.col("_row").cast("string")))
    named = spans.withColumn("words", own_key).join(owner, "words", "left")
    grouped = named.groupBy("_row", "_keep", "_n_words").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], a["end"]))).alias("n"), F.greatest(a["end"], s["b"]).alias("end")),
        lambda a: a["n"],
    )
    return grouped.select("_keep.*", F.col("_n_words").alias("n_words"), covered.alias("n_hit"), "items")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, as they are."""
    key = {"_none": F.col(doc).isNull(), "_id": F.coalesce(F.col(doc).cast("string"), F.lit("")), "_hash": F.xxhash64(text)}
    hit = contamination(docs.select(text, *(c.alias(n) for n, c in key.items())), items, text, tuple(key), **how)
    bad = hit.filter("n_hit > 0").select(*key).distinct()
    return docs.select(packed(docs), *(c.alias(n) for n, c in key.items())).join(bad, list(key), "left_anti").select("_doc.*")
