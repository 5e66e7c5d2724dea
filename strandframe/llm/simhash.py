"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint takes 64 majority votes over the XXH64 (seed 42) of a text's word
shingles.  Two fingerprints at ``radius`` or fewer differing bits share a point at
half the radius from both.  So every distinct fingerprint emits all variants
within ``radius / 2``, one shuffle brings equal variants together, and those that
meet are at most ``radius`` apart.  A variant is met by no more fingerprints than
its own ball has points (65 for radius 2), so no group grows with the data; each
is linked to the smallest of its variant, verified and deduplicated.  That keeps
every component, since all that meet at a variant are linked to each other.

Copies collapse to one row per fingerprint before anything is emitted, and the
classes reach the documents by a join on the fingerprint.

Defined results: null, empty and white-space texts have fingerprint zero and are
linked like any other; null ids never name a class unless all ids of it are null;
repeated rows are documents of their own; ids may be of any type that sorts; an
empty table has no rows.

Reach: the angle between two texts' shingle votes sets how many bits differ.  Two of
64 bits find copies and edits of a word or so in long texts, similarity of about 0.98
and more; tests/llm/test_corpus.py measures the recall at 0.8, 0.9 and 0.98.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.llm.batches import map_texts, packed
from strandframe.operators.graphs import components
from strandframe.session import cut_lineage

SEED = 42
#: Shingles whose bits are in memory at once.
BLOCK = 250_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str, width: int) -> int:
    """Signed 64-bit fingerprint of one text: words between ASCII white space, A-Z in lower case."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    n = max(1, len(words) - width + 1)
    first = (end - size)[:n].tolist()
    last = (end - 1)[len(words) - n :].tolist()
    digest, votes = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(first[k : k + BLOCK], last[k : k + BLOCK])])
        votes += np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), width: int = 3, name: str = "fp") -> DataFrame:
    """``keep`` columns and the fingerprint as a signed long, in place."""

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        return {name: pa.array([fingerprint(t, width) for t in texts], pa.int64())}

    return map_texts(docs, text, keep, f"{name} long", rows)


def ball(radius: int) -> list[int]:
    """Masks with at most ``radius`` of 64 bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links ``(u, v)``, u < v, that span the components of distinct fingerprints ``fp``."""
    if radius % 2:
        raise ValueError("ball hashing by halves takes an even radius")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    met = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    led = met.select("fp", F.min("fp").over(W.partitionBy("variant")).alias("u")).filter("fp <> u").distinct()
    return led.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("u"))) <= radius).select("u", F.col("fp").alias("v"))


def labels(prints: DataFrame, radius: int = 2, doc: str = "doc_id") -> DataFrame:
    """``(fp, first, label)`` of every fingerprint in rows ``(doc, fp)``: its smallest ``doc`` and the least fingerprint of its class."""
    own = cut_lineage(prints.groupBy("fp").agg(F.min(doc).alias("first")))
    node = components(links(own, radius)).withColumnRenamed("node", "fp")
    return cut_lineage(own.join(node, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label")))


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", radius: int = 2, width: int = 3) -> DataFrame:
    """``(doc, fp, component_id)``, one row per document; the class is named by the smallest ``doc`` that is reachable."""
    prints = cut_lineage(fingerprints(docs, text, (doc,), width))
    named = labels(prints, radius, doc)
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "label").select("fp", "component_id"), "fp").select(doc, "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", doc: str = "doc_id", radius: int = 2, width: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each class that with the smallest ``doc`` (null last), then fingerprint, then hash of the text; of its repeats one.

    Fingerprints are worked out once; rows are found again by id and hash of the text.
    """
    hashed = docs.select(F.col(doc).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_h"))
    prints = cut_lineage(fingerprints(hashed, "_text", ("_id", "_h"), width))
    named = labels(prints, radius, "_id")
    own = prints.groupBy("_id", "fp").agg(F.min("_h").alias("_h")).join(named.select("fp", "label"), "fp")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("fp"), F.col("_h"))
    chosen = own.groupBy("label").agg(F.min(order).alias("k"))
    key = ["_none", "_id", "_h"]
    chosen = chosen.select(F.col("k.none").alias("_none"), F.coalesce(F.col("k.id").cast("string"), F.lit("")).alias("_id"), F.col("k._h").alias("_h"))
    rows = docs.select(packed(docs), F.col(doc).isNull().alias("_none"), F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("_id"), F.xxhash64(text).alias("_h"))
    kept = rows.join(chosen, key, "left_semi")
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(1)))
    return kept.withColumn("_n", first).filter("_n = 1").select("_doc.*")
