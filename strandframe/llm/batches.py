"""Arrow batches of texts cut to a bounded size, and a bounded table of chunks already encoded."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Characters of text that a kernel gets at once; a longer single text comes alone.
SLICE = 2_000_000


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """``(first row, texts)`` of consecutive rows; null is the empty text."""
    size = 0
    first, texts = 0, []
    for i in range(len(column)):
        t = column[i].as_py() or ""
        if texts and size + len(t) > limit:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def schema(kept: list[T.StructField], made: str) -> T.StructType:
    """Kept fields of any name and type, then the made ones given as DDL."""
    return T.StructType([*kept, *T.StructType.fromDDL(made).fields])


def packed(docs: DataFrame, name: str = "_doc") -> Column:
    """All columns of ``docs`` as one struct, so that none of their names meets a name made on the way."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name)


def map_texts(docs: DataFrame, text: str, keep: tuple[str, ...], made: str, rows: Callable[[list[str]], dict[str, pa.Array]]) -> DataFrame:
    """Columns ``keep`` of ``docs`` next to the columns that ``rows`` makes from each text, in place (no shuffle).

    Kept columns whose names clash with made ones must be renamed by the caller.
    """
    if clash := set(keep) & {x.split()[0] for x in made.split(", ")}:
        raise ValueError(f"kept columns clash with made ones: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("_text")
            kept = [(n, b.column(i)) for i, n in enumerate(b.schema.names) if i != at]
            for first, texts in text_slices(b.column(at)):
                out = rows(texts)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(first, len(texts)) for _, c in kept] + list(out.values()), names=[n for n, _ in kept] + list(out)
                )

    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    return source.mapInArrow(run, schema(source.schema.fields[:-1], made))


class ChunkCoder:
    """Encodes texts chunk by chunk and remembers the ids of up to ``keep`` distinct chunks.

    A chunk is a part between single spaces; its key is the part itself and stands
    for a space and the part.  Keys that begin with a space stand for what follows
    it, as it is.  Subclasses say how a text with other white space is cut
    (``cut``), what the first part means (``first``) and how strings are encoded
    (``encode_strings``).  The table is emptied when it is full, so its memory is
    bounded; results don't depend on it.
    """

    double = re.compile(r" \s").search

    def __init__(self, keep: int = 900_000):
        self.keep = keep
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def key(s: str) -> str:
        """Key of a non-empty string."""
        return s[1:] if s[0] == " " and len(s) > 1 and " " not in s[1:] else " " + s

    def keys(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or self.double(text):
            return [self.key(s) for s in self.cut(text)]
        parts = text.split(" ")
        parts[0] = self.first(parts[0])
        return parts

    def first(self, part: str) -> str:
        return " " + part

    def cut(self, text: str) -> list[str]:
        raise NotImplementedError

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each string."""
        raise NotImplementedError

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All token ids, one text after the other, and the number of each text."""
        if len(self.known) > self.keep:
            self.forget()
        parts = [self.keys(t) for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            ids, size = self.encode_strings([k[1:] if k[0] == " " else " " + k for k in new])
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
            self.count = np.concatenate([self.count, size])
            self.ids = np.concatenate([self.ids, ids])
        return gathered(parts, self.known, self.start, self.count, self.ids)


def gathered(parts: list[list[str]], known: dict[str, int], start, count, ids) -> tuple[np.ndarray, np.ndarray]:
    """Ids of known chunks in a row, and how many each text has."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    word = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
    n = count[word]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    flat = ids[np.repeat(start[word] - ends + n, n) + np.arange(total)]
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
    return flat, np.diff(bounds)
