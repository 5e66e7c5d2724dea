"""Whole alignments ``(msa_id, ..., a)`` in one kernel call each, many small ones at a time.

A column of letters is never made a row for each of its cells here: rows of
alignments of up to ``ALONE`` characters are dealt into buckets of about
``BUCKET``, and a call gets all rows of a bucket.  Larger alignments are left to
the caller, who counts them cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandframe.session import cut_lineage

#: Characters of an alignment that a kernel call counts, and of a bucket of them.
ALONE, BUCKET = 500_000, 200_000


@dataclass
class Letters:
    """Letters (no gaps) of the rows of a bucket: row, column and code of each; columns of all alignments are numbered through."""

    row: np.ndarray
    column: np.ndarray
    code: np.ndarray
    sets: pa.Array
    of: np.ndarray
    first: np.ndarray

    def same(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct letters of columns: the first of each, which one every letter is, and how many it has."""
        _, at, which, n = np.unique(self.column * 0x110000 + self.code, return_index=True, return_inverse=True, return_counts=True)
        return at, which, n


def letters(rows: pa.Table) -> Letters:
    """``of`` numbers each row's alignment, ``sets`` names them, ``first`` is the number of their first columns."""
    texts = [t or "" for t in rows["a"].to_pylist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    names = rows["msa_id"].combine_chunks().dictionary_encode()
    of = names.indices.to_numpy()
    width = np.zeros(len(names.dictionary), np.int64)
    np.maximum.at(width, of, size)
    first = np.cumsum(width) - width
    row = np.repeat(np.arange(len(texts)), size)
    column = first[of][row] + np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    kept = code != ord("-")
    return Letters(row[kept], column[kept], code[kept], names.dictionary, of, first)


def by_alignment(rows: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: str, larger: Callable[[DataFrame], DataFrame], alone: int = ALONE) -> DataFrame:
    """``kernel`` over buckets of whole alignments, united with ``larger`` over the rows of those with more than ``alone`` characters."""
    rows = rows.filter("msa_id IS NOT NULL")
    size = cut_lineage(rows.groupBy("msa_id").agg(F.coalesce(F.sum(F.length("a")), F.lit(0)).alias("cells")))
    total, most = size.agg(F.sum("cells"), F.max("cells")).first()
    huge = size.filter(F.col("cells") > alone).select("msa_id")
    some = most is not None and most > alone
    small = rows.join(huge, "msa_id", "left_anti") if some else rows
    bucket = F.pmod(F.xxhash64("msa_id"), F.lit((total or 0) // BUCKET + 1))
    done = small.withColumn("_bucket", bucket).groupBy("_bucket").applyInArrow(lambda t: kernel(t), schema)
    return done.unionByName(larger(rows.join(huge, "msa_id", "left_semi"))) if some else done
