"""Composition, word counts and related aggregates over sequences.

Everything explodes inside the task that holds the sequence and relies on
map-side partial aggregation, so only distinct (key, word) pairs are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions import codons as C, residues as R
from strandframe.functions.runs import pieces, text_bytes


def residue_rows(df: DataFrame, *keys: str, seq: str = "s") -> DataFrame:
    return df.select(*keys, F.explode(F.split(seq, "")).alias("residue")).filter("residue != ''")


def word_rows(df: DataFrame, k: int, *keys: str, seq: str = "s", step: int = 1) -> DataFrame:
    words = R.kmers(seq, k) if step == 1 else R.blocks(seq, step)
    return df.select(*keys, F.explode(words).alias("word"))


def composition(df: DataFrame, *keys: str) -> DataFrame:
    return residue_rows(df, *keys).groupBy(*keys, "residue").agg(F.count("*").alias("n"))


def word_counts(df: DataFrame, k: int, *keys: str, alphabet: str | None = None, parity: bool = False) -> DataFrame:
    """Count words of length ``k``.

    Words that contain a letter outside ``alphabet`` are not counted.  With
    ``parity`` the last ``k`` windows of every sequence are left out, which is
    what a loop bounded by ``length - k`` input characters does.
    """
    words = R.kmers("s", k)
    if parity:
        words = F.slice(words, 1, F.greatest(F.size(words) - k, F.lit(0)))
    rows = df.select(*keys, F.explode(words).alias("word"))
    if alphabet:
        rows = rows.filter(F.translate("word", alphabet, "") == "")
    return rows.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def frame_word_counts(df: DataFrame, k: int, code: int = 1) -> DataFrame:
    """``(strand, frame, word, n)``: words of ``k`` (up to 4) amino acids without a stop in all six frames of ``s`` (letters ACGT).

    A word starts at every place; its frame follows from the distance to the end it is read
    from. A task counts into one array over all words, and only its counts are shuffled.
    """
    if not 0 < k < 5:
        raise ValueError("words of 1 to 4 amino acids")
    amino = C.code_string(code)
    letters = "".join(sorted(set(amino) - {"*"}))
    base, many = len(letters), len(letters) ** k
    table = np.array([letters.find(x) for x in amino], np.int64)
    digit = np.full(256, 255, np.uint8)
    digit[np.frombuffer(C.BASES.encode(), np.uint8)] = range(4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(6 * many, np.int64)
        for batch in batches:
            whole, bounds = text_bytes(batch.column(0))
            for low, high in pieces(bounds):
                offs = bounds[low : high + 1] - bounds[low]
                x = digit[whole[bounds[low] : bounds[high]]].astype(np.int64)
                if len(x) and x.max() > 3:
                    raise ValueError("a letter that is no base")
                n = len(x) - 3 * k + 1
                if n < 1:
                    continue
                at, size = np.arange(n), np.diff(offs)
                begin, end = np.repeat(offs[:-1], size)[:n], np.repeat(offs[1:], size)[:n]
                y = (x + 2) % 4  # the complement
                there = table[16 * x[:-2] + 4 * x[1:-1] + x[2:]]
                back = table[16 * y[2:] + 4 * y[1:-1] + y[:-2]]
                for strand, parts, frame in (
                    (0, [there[3 * j : 3 * j + n] for j in range(k)], (at - begin) % 3), (1, [back[3 * j : 3 * j + n] for j in reversed(range(k))], (end - at - 3 * k) % 3)):
                    good, word = at + 3 * k <= end, np.zeros(n, np.int64)
                    for part in parts:
                        good, word = good & (part >= 0), word * base + part
                    found += np.bincount((word + many * (frame + 3 * strand))[good], minlength=6 * many)
        seen = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(found[seen])], ["w", "n"])

    d = df.select("s").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    part = lambda j: F.substring(F.lit(letters), (F.floor(F.col("w") / base**j) % base + 1).cast("int"), F.lit(1))
    return d.select(
        F.when(F.col("w") < 3 * many, "+").otherwise("-").alias("strand"), (F.floor(F.col("w") / many) % 3).cast("int").alias("frame"),
        F.concat(*[part(j) for j in reversed(range(k))]).alias("word"), "n")


def spaced_word_counts(df: DataFrame, mask: str, *keys: str) -> DataFrame:
    """Count spaced seeds: letters under ``1`` of ``mask`` form the word."""
    k = len(mask)
    group = "".join("(.)" if m == "1" else "." for m in mask)
    take = "".join(f"${i + 1}" for i in range(mask.count("1")))
    return (
        df.select(*keys, F.explode(R.kmers("s", k)).alias("word"))
        .groupBy(*keys, "word").agg(F.count("*").alias("n"))
        .groupBy(*keys, F.regexp_replace("word", group, take).alias("word")).agg(F.sum("n").alias("n"))
    )


def observed_expected(df: DataFrame, k: int) -> DataFrame:
    """Observed word count over the count expected from independent residues."""
    words = word_counts(df, k)
    base = composition(df)
    total = base.agg(F.sum("n").alias("total"))
    letters = base.withColumnRenamed("n", "rn")
    out = words
    product: Column = F.lit(1.0)
    for i in range(k):
        side = F.broadcast(letters.select(F.col("residue").alias(f"r{i}"), F.col("rn").alias(f"n{i}")))
        out = out.join(side, F.substring("word", i + 1, 1) == F.col(f"r{i}"))
        product = product * F.col(f"n{i}")
    windows = words.agg(F.sum("n").alias("windows"))
    return (
        out.join(F.broadcast(total)).join(F.broadcast(windows))
        .select("word", "n", (F.col("n") / (product / F.pow(F.col("total").cast("double"), F.lit(k)) * F.col("windows"))).alias("oe"))
    )


def phase_composition(df: DataFrame) -> DataFrame:
    """G+C per cent at each codon phase and overall, and purine per cent, per sequence."""
    d = df.select("seq_id", F.posexplode(F.split("s", "")).alias("p", "r")).filter("r != ''")
    gc, phase = F.col("r").isin("C", "G"), F.col("p") % 3

    def count(cond) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0))

    g = d.groupBy("seq_id").agg(
        F.count("*").alias("n"), count(gc).alias("g"), count(F.col("r").isin("A", "G")).alias("ag"),
        *[count(phase == i).alias(f"n{i}") for i in range(3)], *[count(gc & (phase == i)).alias(f"g{i}") for i in range(3)],
    )

    def pct(k: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.lit(100.0) * F.col(k) / F.col(n))

    return g.select("seq_id", *[pct(f"g{i}", f"n{i}").alias(f"gc{i + 1}") for i in range(3)], pct("g", "n").alias("gc"), pct("ag", "n").alias("purine"))
