"""Spans found in texts as an array column, and texts with spans replaced."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.llm.batches import map_texts

#: A span in code points, end exclusive, with the method's score and what a check said.
Span = tuple[str, int, int, float]
TYPE = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def replaced(text: str, spans: list[Span]) -> str:
    """The text with each span as ``[KIND]``; of overlapping spans the first, then the longest, gives the name and all are covered."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def found(docs: DataFrame, find: Callable[[], Callable[[str], list[Span]]], text: str, keep: tuple[str, ...], name: str, clean: str | None = None) -> DataFrame:
    """``keep`` columns, the spans of each text as ``name`` and, if named, the text with spans replaced as ``clean``.

    ``find`` makes the finder in the worker; null texts have no spans, and an empty ``clean``.
    """

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        scan = find()
        each = [scan(t) for t in texts]
        flat = [s for spans in each for s in spans]
        bounds = [0]
        for s in each:
            bounds.append(bounds[-1] + len(s))
        kinds, starts, ends, scores = zip(*flat) if flat else ((), (), (), ())
        values = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(scores, pa.float64())], fields=list(TYPE))
        out = {name: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)}
        if clean:
            out[clean] = pa.array([replaced(t, s) if s else t for t, s in zip(texts, each)], pa.string())
        return out

    made = f"{name} array<struct<kind:string,start:int,end:int,score:double>>" + (f", {clean} string" if clean else "")
    return map_texts(docs, text, keep, made, rows)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
