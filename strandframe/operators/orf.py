"""Open reading frames and terminal homopolymer tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions import residues as R

STOPS = ("TAA", "TAG", "TGA")


def open_reading_frames(df: DataFrame, min_len: int = 300, from_init: bool = True, stops=STOPS) -> DataFrame:
    """ORFs of the three forward frames: ``(seq_id, frame, pos, len)``, pos 0-based.

    ``from_init``: from the first ATG after a stop to the next stop or the end;
    otherwise the whole stretch between stops.  One fold over the start and stop
    marks of a row keeps an open start per frame; only ORFs leave the row.
    """
    marks = list(stops) + (["ATG"] if from_init else [])
    # position * 8 + mark number
    code = lambda w, i: F.coalesce(*[F.when(w == m, i.cast("long") * 8 + n) for n, m in enumerate(marks)])
    hits = F.filter(F.transform(R.kmers("s", 3), code), lambda x: x.isNotNull())
    opens = -1 if from_init else 0
    empty = F.array().cast("array<struct<frame:int,pos:int,len:int>>")
    start = F.struct(*[F.lit(opens).cast("long").alias(f"s{f}") for f in range(3)], empty.alias("out"))

    def orf(frame, at, end):
        return F.array(F.struct(frame.cast("int").alias("frame"), at.cast("int").alias("pos"), (end - at).cast("int").alias("len")))

    def step(a, h):
        p, m = F.shiftright(h, 3), h.bitwiseAND(F.lit(7).cast("long"))
        f, stop = p % 3, m < len(stops)
        at = F.when(f == 0, a["s0"]).when(f == 1, a["s1"]).otherwise(a["s2"])
        now = F.when(stop, F.lit(-1).cast("long") if from_init else p + 3).otherwise(F.when(at < 0, p).otherwise(at))
        out = F.when(stop & (at >= 0) & (p - at >= min_len), F.concat(a["out"], orf(f, at, p))).otherwise(a["out"])
        return F.struct(*[F.when(f == k, now).otherwise(a[f"s{k}"]).alias(f"s{k}") for k in range(3)], out.alias("out"))

    def finish(a):
        n = F.length("s").cast("long")
        ends = [F.when((a[f"s{k}"] >= 0) & (n - a[f"s{k}"] >= min_len), orf(F.lit(k), a[f"s{k}"], n)).otherwise(empty) for k in range(3)]
        return F.concat(a["out"], *ends)

    return df.select("seq_id", F.inline(F.aggregate(hits, start, step, finish)))


def tail_scan(c, base: str, gain: int, loss: int, thr: int, from_right: bool) -> Column:
    """X-drop scan from one end: struct(best, at) with ``at`` = length of the best tail, 0 if none.

    The running score gains on ``base`` and loses on others; the scan stops
    when it falls more than ``thr`` under its maximum; the last maximum over
    ``thr`` is kept.
    """
    chars = F.split(F.reverse(c) if from_right else R.col(c), "")
    start = F.struct(
        F.lit(0).alias("i"), F.lit(0).alias("score"), F.lit(0).alias("best"), F.lit(0).alias("at"), F.lit(False).alias("done")
    )

    def step(a: Column, ch: Column) -> Column:
        score = a["score"] + F.when(ch == base, gain).otherwise(loss)
        better = score > a["best"]
        best = F.when(better, score).otherwise(a["best"])
        return F.when(a["done"], a).otherwise(
            F.struct(
                (a["i"] + 1).alias("i"), score.alias("score"), best.alias("best"),
                F.when(better & (score > thr), a["i"] + 1).otherwise(a["at"]).alias("at"),
                (score < best - thr).alias("done"),
            )
        )

    return F.aggregate(chars, start, step, lambda a: F.struct(a["best"].alias("best"), a["at"].alias("at")))


def tails(df: DataFrame, gain: int = 1, loss: int = -5, thr: int = 10) -> DataFrame:
    """Poly-A (3' end) and poly-T (5' end) tails; the better one wins, poly-A on ties."""
    d = df.select(
        "seq_id", F.length("s").alias("n"),
        tail_scan("s", "A", gain, loss, thr, True).alias("a"),
        tail_scan("s", "T", gain, loss, thr, False).alias("t"),
    )
    has_a, has_t = F.col("a.at") > 0, F.col("t.at") > 0
    use_a = has_a & (~has_t | (F.col("a.best") >= F.col("t.best")))
    return d.select(
        "seq_id",
        F.when(use_a, "A").when(has_t, "T").otherwise("none").alias("tail"),
        F.when(use_a, F.col("a.at")).when(has_t, F.col("t.at")).otherwise(0).alias("tail_len"),
        F.when(use_a, F.col("n") - F.col("a.at")).when(has_t, F.col("n") - F.col("t.at")).otherwise(F.col("n")).alias("trimmed_len"),
    )
