"""Sliding scores over one sequence, computed in place on its row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions import residues as R
from strandframe.functions.runs import text_bytes


def letter_values(c, values: dict[str, int], other: int = 0) -> Column:
    """Array of one number per letter through a 26-entry array."""
    table = F.array(*[F.lit(values.get(x, other)) for x in R.LETTERS])
    return F.transform(F.split(R.col(c), ""), lambda ch: F.element_at(table, F.ascii(ch) - 64))


def _per_sequence(s: str, returns: str, dtype: pa.DataType, work) -> Column:
    """``work`` on the letter codes (A is 0) of every sequence: a tuple of numbers, or None."""

    def run(texts: pa.Array) -> pa.Array:
        text, offs = text_bytes(texts)
        return pa.array([work(text[offs[i] : offs[i + 1]].astype(np.int64) - 65) for i in range(len(texts))], dtype)

    return F.arrow_udf(run, returns)(R.col(s))


def _longs(*names: str) -> tuple[str, pa.DataType]:
    return ", ".join(f"{n} long" for n in names), pa.struct([(n, pa.int64()) for n in names])


def sliding_extremes(df: DataFrame, values: dict[str, int], width: int) -> DataFrame:
    """Largest and smallest full-window sum and the centre of the first largest one; sequences are letters A-Z.

    Window sums are differences of prefix sums, in one pass over the sequence.
    """
    table = np.array([values.get(x, 0) for x in R.LETTERS], np.int64)

    def work(codes: np.ndarray) -> dict | None:
        if len(codes) < width:
            return None
        upto = np.concatenate([[0], np.cumsum(table[codes])])
        sums = upto[width:] - upto[:-width]
        at = int(sums.argmax())
        return {"max_sum": int(sums[at]), "min_sum": int(sums.min()), "at": at + width - width // 2}

    kind, dtype = _longs("max_sum", "min_sum", "at")
    d = df.filter(F.length("s") >= width).select("seq_id", _per_sequence("s", kind, dtype, work).alias("z"))
    return d.select("seq_id", "z.max_sum", "z.min_sum", "z.at")


def weight_matrix_hits(df: DataFrame, alphabet: str, columns: list[tuple]) -> DataFrame:
    """Best position weight matrix window per sequence and its first position; all letters must be of the alphabet."""
    k = len(columns)
    place = np.full(256, len(alphabet))
    place[[ord(x) - 65 for x in alphabet]] = range(len(alphabet))
    tables = [np.array(c, np.int64) for c in columns]

    def work(codes: np.ndarray) -> dict | None:
        if len(codes) < k:
            return None
        letters = place[codes]
        score = sum(tab[letters[i : len(letters) - k + 1 + i]] for i, tab in enumerate(tables))
        at = int(score.argmax())
        return {"best": int(score[at]), "at": at + 1}

    kind, dtype = _longs("best", "at")
    d = df.filter(F.length("s") >= k).select("seq_id", _per_sequence("s", kind, dtype, work).alias("z"))
    return d.select("seq_id", "z.best", "z.at")


def hexamer_table(df: DataFrame) -> DataFrame:
    """In-phase share of every 6-letter word, per mille above chance: at most 4^6 rows."""
    d = df.select(F.posexplode(R.kmers("s", 6)).alias("p", "word"))
    g = d.groupBy("word").agg(F.count(F.when(F.col("p") % 3 == 0, 1)).alias("k"), F.count("*").alias("n"))
    return g.select("word", (F.floor(F.col("k") * 1000 / F.col("n")) - 333).alias("v"))


def phase_potential(df: DataFrame, table: DataFrame) -> DataFrame:
    """Sum of word potentials per sequence and codon phase; the table is bounded by its alphabet."""
    d = df.select("seq_id", F.posexplode(R.kmers("s", 6)).alias("p", "word"))
    return d.join(F.broadcast(table), "word").groupBy("seq_id", (F.col("p") % 3).cast("long").alias("phase")).agg(F.sum("v").alias("potential"))


def cumulative_peak(df: DataFrame, values: dict[str, int], other: int) -> DataFrame:
    """Peak of the running sum, its first position and the total."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("i"), zero.alias("s"), F.lit(None).cast("long").alias("hi"), zero.alias("at"))

    def step(a: Column, x: Column) -> Column:
        i, s = a["i"] + 1, a["s"] + x
        up = a["hi"].isNull() | (s > a["hi"])
        return F.struct(i.alias("i"), s.alias("s"), F.when(up, s).otherwise(a["hi"]).alias("hi"), F.when(up, i).otherwise(a["at"]).alias("at"))

    d = df.filter("s != ''").select("seq_id", F.aggregate(letter_values("s", values, other), start, step).alias("z"))
    return d.select("seq_id", F.col("z.hi").alias("peak"), F.col("z.at").alias("peak_at"), F.col("z.s").alias("total"))
