"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is reduced to lower-case letters with single marks between its words; its
1- to 3-grams are hashed to ``BUCKETS`` features with value
``(1 + ln tf) * idf`` and unit length.  Document frequencies come from all
documents that may be learned from, counted in the tasks.  The weights are fitted
on a sample of at most ``SAMPLE`` of these documents, the same number of each
language, drawn by hash: follow-the-regularised-leader with per-coordinate rates
and an elastic net, so that most weights are exactly zero.  A part of the sample is
set aside to fit one temperature, by which scores are divided before the softmax.

Documents whose ``crc32(id as text) % 5`` is 0, or with a null id or language, are
never learned from.  Only the text is used in a prediction.

Defined results: null texts and texts without a letter get ``und`` and score 0;
so does everything if there is nothing to learn from.  With one language only it
is predicted with score 1.  Ties go to the language that comes first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.llm.batches import map_texts, text_slices

#: Hashed features, a power of two; documents in the fitting sample at most; n-gram lengths.
BUCKETS, SAMPLE, ORDERS = 1 << 15, 6000, (1, 2, 3)
#: Documents whose dense counts are in memory at once.
ROWS = 64
UND = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def _codes(text: str) -> np.ndarray:
    """Letters in lower case, with a zero before, between and after words."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate([[0], np.where(_letters()[c], c, 0), [0]]).astype(np.uint64)
    return c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]


def _grams(codes: np.ndarray) -> np.ndarray:
    """Feature of every n-gram."""
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(codes) - n + 1] * np.uint64(0x100000001B3)) ^ codes[n - 1 :]
        if n in ORDERS:
            out.append((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xC2B2AE3D27D4EB4F % 2**64)) >> np.uint64(49))
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int64)


def counts_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Dense counts of up to ``ROWS`` texts at a time; a text without letters has none."""
    for k in range(0, len(texts), ROWS):
        part = texts[k : k + ROWS]
        out = np.zeros((len(part), BUCKETS), np.int64)
        for i, t in enumerate(part):
            c = _codes(t)
            if c.any():
                out[i] = np.bincount(_grams(c), minlength=BUCKETS)
        yield out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each row's languages, and whether the row has a letter."""
        some = counts.any(axis=1)
        row, col = np.nonzero(counts)
        x = values(counts[row, col], self.idf[col])
        norm = np.sqrt(np.bincount(row, x * x, len(counts)))
        z = np.zeros((len(counts), len(self.languages)))
        for j in range(len(self.languages)):
            z[:, j] = np.bincount(row, x * self.weights[col, j], len(counts)) / np.maximum(norm, 1e-12) + self.bias[j]
        return softmax(z / self.temperature), some


def values(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(n)) * idf


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, rate: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 1e-4, rounds: int = 3):
    """Weights and bias by follow-the-regularised-leader over ``(class, features, values)`` rows, in their order."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))  # the last row is the bias

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / rate + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    for _ in range(rounds):
        for c, at, x in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[c] -= 1
            g = np.outer(x, p)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, classes: np.ndarray) -> float:
    """Temperature with the least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(classes)), classes], 1e-12)).sum()
    low, high, g = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def learnable(doc: str = "doc_id", lang: str = "lang") -> Column:
    return F.coalesce(F.crc32(F.col(doc).cast("string").cast("binary")) % 5 != 0, F.lit(False)) & F.col(lang).isNotNull()


def document_frequency(docs: DataFrame, text: str) -> np.ndarray:
    """Documents (with a letter) that have each feature, and at the end all of them; summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for _, texts in text_slices(b.column(0)):
                for counts in counts_of(texts):
                    total[:-1] += (counts > 0).sum(axis=0)
                    total[-1] += counts.any(axis=1).sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = docs.select(F.col(text).cast("string")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS + 1, np.int64)
    for r in found.collect():  # one row per feature
        out[r["at"]] = r["n"]
    return out


def flat_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and bounds of a column of lists, without an object per value."""
    parts = [c for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    size = np.concatenate([np.diff(c.offsets.to_numpy()) for c in parts])
    return np.concatenate([c.flatten().to_numpy() for c in parts]), np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def train(docs: DataFrame, text: str = "text", doc: str = "doc_id", lang: str = "lang", sample: int = SAMPLE) -> Model:
    known = docs.filter(learnable(doc, lang))
    # repeated rows are one row of the sample: what is drawn are distinct keys
    order = F.xxhash64(doc, text).bitwiseAND(F.lit(2**53 - 1))
    keys = known.select(F.col(lang).alias("_lang"), order.alias("_order")).distinct()
    sizes = {r["_lang"]: r["count"] for r in keys.groupBy("_lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS, 0)), np.zeros(0))
    seen = document_frequency(known, text)
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    each = max(2, sample // len(languages))
    # keys below a bound of about `each` and a margin come to the driver, which cuts each language exactly
    part = F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(int(min(1.0, (1.2 * each + 100) / sizes[c]) * 2**53)))])
    drawn: dict[str, list[int]] = {c: [] for c in languages}
    for r in keys.filter(F.col("_order") <= part[F.col("_lang")]).collect():
        drawn[r["_lang"]].append(r["_order"])
    last = F.create_map(*[x for c in languages for x in (F.lit(c), F.lit(sorted(drawn[c])[:each][-1] if drawn[c] else -1))])
    drawn = known.select(F.col(lang).alias("_lang"), order.alias("_order"), F.col(text).alias("_text")).filter(F.col("_order") <= last[F.col("_lang")])

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        at, n = [], []
        for counts in counts_of(texts):
            for c in counts:
                at.append(np.flatnonzero(c).astype(np.int32))
                n.append(c[at[-1]].astype(np.int32))
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in at])]), pa.int32())
        return {k: pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(v), pa.int32())) for k, v in (("at", at), ("n", n))}

    got = map_texts(drawn, "_text", ("_lang", "_order"), "at array<int>, n array<int>", rows).filter("size(at) > 0")
    got = got.dropDuplicates(["_lang", "_order"]).toArrow().combine_chunks()  # `each` rows of a language at most
    ranks = {c: i for i, c in enumerate(languages)}
    label = [ranks[c] for c in got["_lang"].to_pylist()]
    at, n = (flat_lists(got[c]) for c in ("at", "n"))
    taken, examples = [0] * len(languages), []
    for i in np.lexsort((label, got["_order"].to_numpy())):
        taken[label[i]] += 1
        if taken[label[i]] <= each:
            own = at[0][at[1][i] : at[1][i + 1]]
            x = values(n[0][n[1][i] : n[1][i + 1]].astype(float), idf[own])
            examples.append((label[i], own, (x / np.sqrt((x * x).sum())).astype(np.float32)))
    fitted = [e for i, e in enumerate(examples) if i % 5] or examples
    aside = examples[::5]
    w, b = fit(fitted, len(languages))
    logits = np.array([x @ w[at] + b for _, at, x in aside]).reshape(len(aside), len(languages))
    return Model(languages, idf, w, b, calibrate(logits, np.array([c for c, _, _ in aside], int)) if len(aside) else 1.0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        m, pred, score = shared.value, [], []
        if not m.languages:
            return {"lang_pred": pa.array([UND] * len(texts), pa.string()), "score": pa.array([0.0] * len(texts), pa.float64())}
        for counts in counts_of(texts):
            p, some = m.scores(counts)
            best = p.argmax(axis=1)
            pred += [m.languages[b] if s else UND for b, s in zip(best, some)]
            score += [float(v) if s else 0.0 for v, s in zip(p.max(axis=1), some)]
        return {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}

    return map_texts(docs, text, keep, "lang_pred string, score double", rows)
