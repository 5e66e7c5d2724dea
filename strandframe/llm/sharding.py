"""Extendible hashing: a directory over hash-prefix bits whose oversized buckets alone split on one more bit.

A row's hash is 60 bits of MD5 over its key.  A bucket is a prefix; a bucket with
more than ``limit`` bytes splits on its next bit until every shard fits.  Rows are
summed by a fine prefix in the tasks, before the shuffle; splitting works on these
sums, so a round handles prefixes, not rows.  Only if a fine prefix is itself too
large, the rows behind it alone are summed by longer prefixes.  Documents learn
their shard by a join on the fine prefix.

Rows that agree in all 60 bits can't be parted by hashing: a bucket of one hash
becomes ``pieces`` of its rows in order of arrival, each filled up to the limit,
numbered by sums within input blocks and over blocks, never in one task.  A row
larger than the limit is a shard of its own; only such shards exceed it.

Defined results: null texts count zero bytes; null keys hash as the empty string;
shards of repeated rows differ only by piece; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandframe.llm.batches import packed
from strandframe.session import cut_lineage

BITS = 60


def key_hash(*keys: str) -> Column:
    """60 bits of MD5 over the keys as text."""
    joined = F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def prefix(h: str, depth: int | str) -> Column:
    """The first ``depth`` bits."""
    return F.expr(f"shiftright({h}, {BITS} - {depth})")


def directory(rows: DataFrame, limit: int, start: int) -> DataFrame:
    """``(p, fine, depth, bytes, single)``: for every fine prefix that rows ``(h, bytes)`` have, its bucket's depth, size and whether one hash fills it.

    ``fine`` is the number of bits of ``p``; it is larger than ``start`` only below prefixes that are still too large there.
    """
    out, rest, above, fine = None, rows, 0, start
    while True:
        sums = cut_lineage(rest.groupBy(prefix("h", fine).alias("p")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")))
        each = sums.select("*", F.explode(F.sequence(F.lit(above), F.lit(fine))).alias("depth")).withColumn("q", prefix("low", "depth"))
        size = each.groupBy("depth", "q").agg(F.sum("bytes").alias("bytes"), (F.min("low") == F.max("high")).alias("single"))
        met = each.select("p", "depth", "q").join(size, ["depth", "q"])
        fits = (F.col("bytes") <= limit) | F.col("single") | (F.col("depth") == BITS)
        least = met.filter(fits).groupBy("p").agg(F.min(F.struct("depth", "bytes", "single")).alias("b"))
        found = cut_lineage(sums.select("p").join(least, "p", "left").select("p", F.lit(fine).alias("fine"), "b.*"))
        done, large = found.filter("depth IS NOT NULL"), found.filter("depth IS NULL").select("p")
        out = done if out is None else out.unionByName(done)
        if large.isEmpty():
            return out
        rest = rest.withColumn("p", prefix("h", fine)).join(large, "p", "left_semi").drop("p")
        above, fine = fine + 1, min(BITS, fine + 8)


def shards(docs: DataFrame, limit: int, text: str = "text", keys: tuple[str, ...] = ("doc_id",), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``shard`` (bits of the prefix, and ``.piece`` for rows of one hash), ``depth``, ``n_bytes`` and ``shard_bytes``."""
    if clash := set(keep) & {"shard", "depth", "n_bytes", "shard_bytes"}:
        raise ValueError(f"kept columns clash with made ones: {sorted(clash)}")
    rows = docs.select(packed(docs.select(*keep), "_keep"), key_hash(*keys).alias("h"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.spark_partition_id().alias("_block"))
    rows = cut_lineage(rows)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    d = directory(rows.select("h", "bytes"), limit, min(BITS, 3 + (total // limit).bit_length()))  # eight sums for each shard to be
    levels = [r["fine"] for r in d.select("fine").distinct().collect()]  # a handful of levels
    tagged = None
    for fine in sorted(levels):
        part = rows.withColumn("p", prefix("h", fine)).join(d.filter(F.col("fine") == fine).drop("fine").withColumnRenamed("bytes", "shard_bytes"), "p")
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        tagged = rows.select("_keep", "h", "bytes", "_block", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(False).alias("single"))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(shiftright(h, %d - depth)), depth, '0')" % BITS))
    named = tagged.select("_keep", "h", "bytes", "_block", "depth", "shard_bytes", "single", bits.alias("shard"))
    whole = named.filter(~F.col("single") | (F.col("shard_bytes") <= limit)).select("_keep.*", "shard", "depth", F.col("bytes").alias("n_bytes"), "shard_bytes")
    over = named.filter(F.col("single") & (F.col("shard_bytes") > limit))
    return whole.unionByName(_pieces(over, limit))


def _pieces(over: DataFrame, limit: int) -> DataFrame:
    """Rows of one hash each, in pieces: equal rows have equal sizes, so the size gives how many fit, and the running number the piece.

    Numbers are counted within (hash, size, block) and summed over blocks.
    """
    group = ["h", "bytes"]
    blocks = over.groupBy(*group, "_block").count()
    before = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)  # a row per input block
    base = blocks.select(*group, "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    total = blocks.groupBy(*group).agg(F.sum("count").alias("total"))
    own = over.withColumn("k", F.row_number().over(W.partitionBy(*group, "_block").orderBy("_block"))).join(base, [*group, "_block"]).join(total, group)
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1)))).cast("long")
    number = F.col("base") + F.col("k") - 1
    piece = F.floor(number / fit).cast("long")
    size = F.least(fit, F.col("total") - piece * fit) * F.col("bytes")
    return own.select("_keep.*", F.concat("shard", F.lit("."), F.col("bytes").cast("string"), F.lit("."), piece.cast("string")).alias("shard"), "depth", F.col("bytes").alias("n_bytes"), size.alias("shard_bytes"))
