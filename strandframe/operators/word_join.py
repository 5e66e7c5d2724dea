"""Word-index joins between a query set and a sequence database.

Similarity is the shared word count over the smaller total.  A pair can only
reach the threshold if it meets within the *prefix* of its smaller member: the
rarest words, up to the point where the rest cannot make the threshold any
more.  Only prefix words make candidates, and every candidate is verified on all
words, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.functions import residues as R
from strandframe.functions.runs import pieces, text_bytes
from strandframe.session import cut_lineage


def word_table(df: DataFrame, ident: str, k: int) -> DataFrame:
    """``(ident, word, n, total)`` of every sequence with at least one word.

    The array is exploded where it is built: naming it first would make the
    optimizer add null and size filters that build it again below the explode.
    """
    n = df.select(ident, F.explode(R.kmers("s", k)).alias("word")).groupBy(ident, "word").agg(F.count("*").alias("n"))
    return n.join(n.groupBy(ident).agg(F.sum("n").alias("total")), ident)


#: Letters of a word that one number holds.
CODED = 13


def _joined(x: np.ndarray, width: int) -> np.ndarray:
    """One number for the ``width`` letters from every place on, put together from stretches of doubled lengths."""
    out, have, piece, size = None, 0, x, 1
    while True:
        if width & size:
            out = piece if out is None else out[: len(piece) - have] * 27**size + piece[have:]
            have += size
        if have == width:
            return out
        piece = piece[: len(piece) - size] * 27**size + piece[size:]
        size *= 2


def _coded(text: np.ndarray, offs: np.ndarray, k: int, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(row, place, codes)`` of all words of ``k`` letters A-Z, or with ``flags`` of those that may be known: one number for every ``CODED`` of a word's letters."""
    if len(text) and (text.min() < 65 or text.max() > 90):
        raise ValueError("sequences are letters A-Z")
    n = len(text) - k + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, [none for _ in range(0, k, CODED)]
    x = text.astype(np.int64) - 64
    codes = [_joined(x[low : n + min(k, low + CODED) - 1], min(k - low, CODED)) for low in range(0, k, CODED)]
    at = np.arange(n) if flags is None else np.flatnonzero(_known(flags, codes))
    row = np.searchsorted(offs, at, "right") - 1 if flags is not None else np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:n]
    inside = at + k <= offs[1:][row]
    row, at = row[inside], at[inside]
    return row, at - offs[row], [c[at] for c in codes]


#: Log2 of the bits that say which words the other side may have.
BITS = 23


def _slots(codes: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def known_words(df: DataFrame, k: int) -> np.ndarray:
    """One flag per slot of hashed words of ``s``: of fixed size, whatever the number of sequences. A set flag may be chance, so a join has to follow."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << BITS, bool)
        for batch in batches:
            text, offs = text_bytes(batch.column(0))
            for low, high in pieces(offs):
                flags[_slots(_coded(text[offs[low] : offs[high]], offs[low : high + 1] - offs[low], k)[2])] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(flags).tobytes()], pa.binary())], ["flags"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for row in df.select("s").mapInArrow(mark, "flags binary").toLocalIterator():  # one part at a time
        out |= np.frombuffer(row[0], np.uint8)
    return out


def _known(flags: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
    at = _slots(codes)
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def word_places(df: DataFrame, ident: str, k: int, place: str, flags: np.ndarray | None = None) -> DataFrame:
    """``(ident, place, w0, ...)``: every overlapping word of ``s`` as numbers, places from 0; with ``flags`` only words that may be known."""
    d = df.select(ident, "s")
    names = [f"w{i}" for i in range(-(-k // CODED))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offs = text_bytes(batch.column(1))
            for low, high in pieces(offs):
                row, at, codes = _coded(text[offs[low] : offs[high]], offs[low : high + 1] - offs[low], k, flags)
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + low)), pa.array(at.astype(np.int32)), *map(pa.array, codes)], [ident, place, *names])
                yield from (out.slice(i, 1 << 16) for i in range(0, len(row), 1 << 16))

    return d.mapInArrow(find, f"{ident} {d.dtypes[0][1]}, {place} int, " + ", ".join(f"{n} long" for n in names))


def coded_counts(df: DataFrame, ident: str, k: int, flags: np.ndarray | None = None) -> DataFrame:
    """``(ident, total, word, n)``: the words of every sequence as numbers, with their counts; ``total`` counts all, with ``flags`` only words that may be known have a row."""
    d = df.select(ident, "s")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, offs = text_bytes(batch.column(1))
            for low, high in pieces(offs):
                row, _, (code,) = _coded(text[offs[low] : offs[high]], offs[low : high + 1] - offs[low], k, flags)
                totals = np.maximum(np.diff(offs[low : high + 1]) - (k - 1), 0)
                ends = np.searchsorted(row, np.arange(high - low + 1))
                words = [np.unique(code[a:b], return_counts=True) for a, b in zip(ends, ends[1:])]
                many = np.array([len(w) for w, _ in words])
                cols = [np.repeat(totals, many), *(np.concatenate([w[i] for w in words]) for i in (0, 1))]
                out = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(low, high), many))), *map(pa.array, cols)], [ident, "total", "word", "n"])
                yield from (out.slice(i, 1 << 16) for i in range(0, out.num_rows, 1 << 16))

    return d.mapInArrow(find, f"{ident} {d.dtypes[0][1]}, total long, word long, n long")


def needed(total, t: float):
    return F.ceil(total * t - 1e-9)


def similar_sequences(queries: DataFrame, db: DataFrame, k: int, t: float) -> DataFrame:
    """Exact ``(q_id, seq_id, shared, f)`` with shared words / smaller total >= ``t``.

    One pass over the database keeps, per sequence, the counts of words that occur
    in some query; its total needs no words.  Words are taken rarest first, by the
    number of sequences that have them: a similar pair has to meet in the first
    words of the query or of the sequence, whichever is smaller, and pairs that
    meet nowhere there are never made.  Counts travel, texts don't.
    """
    coded = k <= CODED  # longer words stay letters
    q = cut_lineage(coded_counts(queries, "q_id", k) if coded else word_table(queries, "q_id", k)).select("q_id", "word", F.col("n").alias("qn"), F.col("total").alias("q_total"))
    vocabulary = q.select("word").distinct()
    if coded:
        words = coded_counts(db, "seq_id", k, known_words(queries, k))
    else:
        words = db.select("seq_id", (F.length("s") - (k - 1)).cast("long").alias("total"), F.explode(R.kmers("s", k)).alias("word"), F.lit(1).cast("long").alias("n"))
    d = cut_lineage(words.join(vocabulary, "word", "left_semi").groupBy("seq_id", "total", "word").agg(F.sum("n").alias("n")))
    freq = d.groupBy("word").agg(F.count("*").alias("df"))
    first_q = _first(q.join(freq, "word"), "q_id", "q_total", "qn", t)
    first_d = _first(d.join(freq, "word"), "seq_id", "total", "n", t)
    small_q = d.join(first_q.select("word", "q_id", "q_total"), "word").filter("q_total <= total").select("q_id", "seq_id")
    small_d = first_d.join(q.select("word", "q_id", "q_total"), "word").filter("total < q_total").select("q_id", "seq_id")
    pairs = small_q.unionByName(small_d).distinct()
    met = pairs.join(d, "seq_id").join(q, ["q_id", "word"])
    g = met.groupBy("q_id", "seq_id", F.least("total", "q_total").alias("smaller")).agg(F.sum(F.least("n", "qn")).alias("shared"))
    return g.filter(F.col("shared") >= needed(F.col("smaller"), t)).select(
        "q_id", "seq_id", "shared", (F.col("shared") / F.col("smaller").cast("double")).alias("f")
    )


def _first(words: DataFrame, ident: str, total: str, n: str, t: float) -> DataFrame:
    """The rarest words of every member that a similar pair cannot all miss.

    ``words`` are those known to the other side, so a pair's shared counts lie
    among them; with ``have`` counts in all, a pair that shares ``need`` must meet
    within the first ``have - need + 1``.  Members with fewer than ``need`` drop out.
    """
    w = W.partitionBy(ident)  # the words of one member
    order = w.orderBy("df", "word").rowsBetween(W.unboundedPreceding, -1)
    d = words.withColumn("have", F.sum(n).over(w)).withColumn("used", F.coalesce(F.sum(n).over(order), F.lit(0)))
    return d.filter(F.col("used") <= F.col("have") - needed(F.col(total), t))


def diagonal_matches(queries: DataFrame, db: DataFrame, k: int) -> DataFrame:
    """Maximal exact matches of length >= k: ``(q_id, seq_id, q_start, d_start, len)``.

    Seeds are an equi-join on the word, as numbers; neighbours on one diagonal are merged.
    """
    q, d = word_places(queries, "q_id", k, "qp"), word_places(db, "seq_id", k, "dp", known_words(queries, k))
    seeds = d.join(q, [c for c in q.columns if c.startswith("w")]).select("q_id", "seq_id", (F.col("dp") - F.col("qp")).alias("diag"), "qp")
    w = W.partitionBy("q_id", "seq_id", "diag").orderBy("qp")  # one diagonal of one pair
    runs = seeds.withColumn("run", F.col("qp") - F.row_number().over(w)).groupBy("q_id", "seq_id", "diag", "run").agg(
        F.min("qp").alias("qp"), F.count("*").alias("n")
    )
    return runs.select(
        "q_id", "seq_id", (F.col("qp") + 1).cast("long").alias("q_start"), (F.col("qp") + F.col("diag") + 1).cast("long").alias("d_start"),
        (F.col("n") + (k - 1)).alias("len"),
    )


def apart(hits: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` matches of each pair that overlap on neither side: ``(q_id, seq_id, rk, q_start, d_start, len)``.

    In every round the longest match left (ties: first in the query, then in the
    entry) is taken and what overlaps it leaves; matches needn't meet in one task.
    """
    rest, out = cut_lineage(hits), []
    for rk in range(1, limit + 1):
        key = F.struct("len", -F.col("q_start"), -F.col("d_start"))
        best = rest.groupBy("q_id", "seq_id").agg(F.max_by(F.struct("q_start", "d_start", "len"), key).alias("b"))
        best = cut_lineage(best.select("q_id", "seq_id", F.lit(rk).cast("long").alias("rk"), "b.*"))
        out.append(best)
        if rk == limit or best.isEmpty():
            break
        b = best.select("q_id", "seq_id", *[F.col(c).alias(f"b_{c}") for c in ("q_start", "d_start", "len")])
        free = [(F.col(c) + F.col("len") <= F.col(f"b_{c}")) | (F.col(f"b_{c}") + F.col("b_len") <= F.col(c)) for c in ("q_start", "d_start")]
        rest = cut_lineage(rest.join(b, ["q_id", "seq_id"]).filter(free[0] & free[1]).select(*hits.columns))
    return reduce(DataFrame.unionByName, out)


def orientation_vote(queries: DataFrame, db: DataFrame, k: int) -> DataFrame:
    """Word matches of each query and of its reverse complement with the whole database.

    The database is reduced to word counts first, so the join is linear in
    distinct words.
    """
    words = db.select(F.explode(R.kmers("s", k)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    both = queries.select("q_id", F.inline(F.array(
        F.struct(F.lit("+").alias("strand"), F.col("s").alias("x")), F.struct(F.lit("-").alias("strand"), R.reverse_complement("s").alias("x"))
    )))
    q = both.select("q_id", "strand", F.explode(R.kmers("x", k)).alias("word"))
    votes = q.join(words, "word").groupBy("q_id").agg(
        F.sum(F.when(F.col("strand") == "+", F.col("n")).otherwise(0)).alias("forward"),
        F.sum(F.when(F.col("strand") == "-", F.col("n")).otherwise(0)).alias("reverse"),
    )
    return votes.withColumn("strand", F.when(F.col("forward") >= F.col("reverse"), "+").otherwise("-"))
