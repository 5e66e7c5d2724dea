"""Maximal runs inside one string, found on the bytes of Arrow batches in linear time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions.residues import col

LETTER = "[A-Za-z]"
GAP = "-"
_CLASSES = {LETTER: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", GAP: "-"}
#: Bytes of text that are worked on at once.
PIECE = 1 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array and the offsets of the rows; a null has none."""
    a = texts.cast(pa.large_string())
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = a.buffers()
    offs = np.frombuffer(offs, np.int64, len(a) + 1, a.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def pieces(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``PIECE`` bytes, a longer row alone."""
    low = 0
    while low < len(offs) - 1:
        high = max(low + 1, int(np.searchsorted(offs, offs[low] + PIECE, "right")) - 1)
        yield low, high
        low = high


def run_ranges(text: np.ndarray, offs: np.ndarray, inside: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, l, r)`` of every run in row order, half-open and in code points of its row."""
    table = np.zeros(256, bool)
    table[np.frombuffer(_CLASSES[inside].encode(), np.uint8)] = True
    mark = table[text]
    full = offs[:-1] < offs[1:]
    before, after = np.zeros_like(mark), np.zeros_like(mark)
    before[1:], after[:-1] = mark[:-1], mark[1:]
    before[offs[:-1][full]] = False
    after[offs[1:][full] - 1] = False
    l, r = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    row = np.searchsorted(offs, l, "right") - 1
    base = offs[row]
    if len(text) and text.max() > 127:  # bytes that go on with a character don't count
        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        l, r, base = points[l], points[r], points[base]
    return row, l - base, r - base


def _offsets(row: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)


def runs(c, inside: str = LETTER) -> Column:
    """Array of struct(l, r): half-open 0-based ranges of the runs of the character class ``inside``."""

    def find(texts: pa.Array) -> pa.Array:
        text, offs = text_bytes(texts)
        found = [np.zeros((3, 0), np.int64)]
        for low, high in pieces(offs):
            row, l, r = run_ranges(text[offs[low] : offs[high]], offs[low : high + 1] - offs[low], inside)
            found.append(np.stack([row + low, l, r]))
        row, l, r = np.concatenate(found, axis=1)
        ranges = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (l, r)], ["l", "r"])
        return pa.ListArray.from_arrays(pa.array(_offsets(row, len(texts))), ranges, mask=texts.is_null())

    return F.arrow_udf(find, "array<struct<l:int,r:int>>")(col(c))


def run_table(df: DataFrame, text: str, *keys: str, inside: str = LETTER) -> DataFrame:
    """``(*keys, no, l, r, next, cds_l, cds_r, cds_len)`` of every run: its number from 1, its range, where the next one of
    its row begins (or null), its range when everything outside is cut away, and the length of what is left of the row."""
    d = df.select(*keys, text)
    kinds = ", ".join(f"`{k}` {t}" for k, t in d.dtypes[:-1])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offs = text_bytes(batch.column(len(keys)))
            for low, high in pieces(offs):
                row, l, r = run_ranges(whole[offs[low] : offs[high]], offs[low : high + 1] - offs[low], inside)
                if not len(row):
                    continue
                first = _offsets(row, high - low)
                ends = np.concatenate([[0], np.cumsum(r - l)])
                no, right = np.arange(1, len(row) + 1) - first[row], ends[1:] - ends[first[row]]
                size = ends[first[row + 1]] - ends[first[row]]
                last = np.append(row[1:] != row[:-1], True)
                at, following = pa.array(row + low), pa.array(np.append(l[1:], 0), mask=last)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(at) for i in range(len(keys))] + [pa.array(x.astype(np.int64)) for x in (no, l, r)] + [following]
                    + [pa.array(x.astype(np.int64)) for x in (right - (r - l), right, size)],
                    [*keys, "no", "l", "r", "next", "cds_l", "cds_r", "cds_len"])

    return d.mapInArrow(find, f"{kinds}, no long, l long, r long, next long, cds_l long, cds_r long, cds_len long")


def residue_sites(c) -> Column:
    """Sites (1-based) of the non-gap characters of an aligned row, in residue order."""
    marked = F.transform(F.split(col(c), ""), lambda ch, i: F.when(~ch.isin("-", ""), i + 1))
    return F.filter(marked, lambda x: x.isNotNull())
