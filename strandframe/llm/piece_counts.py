"""Token counts of a sentence-piece BPE model by rank-synchronous merging of ragged arrays.

Pre-tokens (white space marks and the part after them) of a batch lie one after
the other in one array of symbols.  In every round each pre-token applies its
lowest-rank pair (of equals the leftmost), all pre-tokens at once; the array is
compacted, and pre-tokens without a pair leave with the number of surviving
symbols.  Characters outside the vocabulary count as their UTF-8 bytes (byte
fallback).  Pre-tokens of like length go through the rounds together, so that few
long ones don't carry many short ones along; only those longer than ``WIDEST``
symbols, whose rounds cost the square of their length, take a heap with the same merges.

Defined results: null and empty texts have no tokens and no bytes; strings that
look like control symbols are ordinary text; every row is counted for itself.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from strandframe.llm.batches import ChunkCoder, map_texts
from strandframe.llm.byte_bpe import NONE, PairTable, heap_merge

#: Upper lengths of the classes that go through the rounds together, in symbols.
WIDTHS = (96, 192, 384, 768, 1536, 4096)
WIDEST = WIDTHS[-1]
MARK = "▁"
#: Symbols in the ragged array at once.
BLOCK = 2_000_000


class PieceCounter(ChunkCoder):
    """Counts what the library gives for a model without normalisation but the leading mark; other models are refused."""

    def __init__(self, path: str, keep: int = 900_000):
        super().__init__(keep)
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "  aﬁ Å　 b\tc "
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model normalises texts; only the identity with a leading mark is handled")
        size = sp.vocab_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in normal):
            raise ValueError("models with unused pieces are not handled")
        pieces = {sp.id_to_piece(i): i for i in normal}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans a word boundary")
        score = {i: sp.get_score(i) for i in normal}
        order = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbols = dict(pieces)
        for c in sorted(set("".join(pieces))):
            symbols.setdefault(c, len(symbols) + size)
        left, right, whole = [], [], []
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    left.append(symbols[p[:k]])
                    right.append(symbols[p[k:]])
                    whole.append(i)
        top = max(symbols.values()) + 5
        rank = np.array([order[score[i]] for i in whole], np.int32)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), rank, np.array(whole, np.int32), top)
        code = np.arange(0x110000)
        self.symbol = (top - 5 + 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)).astype(np.int32)
        self.weight = np.ones(top, np.int64)
        self.weight[top - 4 :] = (1, 2, 3, 4)  # bytes of an unknown character
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
                if s not in pieces:
                    self.weight[i] = len(s.encode())
        # a line end inside no longer piece can't be merged over: lines are cut there
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.lines = "\n" not in joined
        self.find_parts = re.compile(r" *[^ \n]+|\n+| +" if self.lines else r" *[^ ]+| +").findall

    def first(self, part: str) -> str:
        return part

    def cut(self, text: str) -> list[str]:
        raise AssertionError("keys() cuts")

    def keys(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        if text[0] == " " or text[-1] == " " or "  " in text:
            return [p[1:] if p[0] == " " and p.count(" ") == 1 and len(p) > 1 else " " + p for p in re.findall(r" *[^ ]+| +", " " + text)]
        return text.split(" ")

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """No ids; the count of each string as its size."""
        pieces = [self.find_parts(s) for s in strings]
        words = dict.fromkeys(chain.from_iterable(pieces))
        for i, w in enumerate(words):
            words[w] = i
        count = self.count_words([w.replace(" ", MARK) for w in words])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        each = count[np.fromiter(map(words.__getitem__, chain.from_iterable(pieces)), np.int64, int(sizes.sum()))]
        ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])]
        return np.zeros(0, np.int32), np.diff(ends)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text."""
        if len(self.known) > self.keep:
            self.forget()
        parts = [self.keys(t) for t in texts]
        new = list(set(chain.from_iterable(parts)).difference(self.known))
        if new:
            _, size = self.encode_strings([k[1:] if k[:1] == " " else " " + k for k in new])
            self.known.update(zip(new, size.tolist()))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        each = np.fromiter(map(self.known.__getitem__, chain.from_iterable(parts)), np.int64, int(sizes.sum()))
        return np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(sizes)])])

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of every pre-token, which is not empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(sizes > WIDEST):
            ids = self.symbol[np.frombuffer(words[i].encode("utf-32-le"), np.uint32)].tolist()
            out[i] = self.weight[heap_merge(ids, self.pairs.known().get)].sum()
        for low, high in zip((0, *WIDTHS), WIDTHS):
            group = np.flatnonzero((sizes > low) & (sizes <= high))
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes[group]) // BLOCK)) + 1
            for part in np.split(group, cuts) if len(group) else ():
                out[part] = self._rounds("".join([words[i] for i in part]), sizes[part])
        return out

    def _rounds(self, joined: str, sizes: np.ndarray) -> np.ndarray:
        find, ranks, merged = self.pairs.find, self.pairs.rank, self.pairs.merged
        sym = self.symbol[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        owner, live, out = np.arange(len(sizes)), sizes.copy(), np.zeros(len(sizes), np.int64)
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = ranks[find(sym[:-1], sym[1:])]
        rank[np.cumsum(live) - 1] = NONE  # the last symbol of a sequence has no pair
        while len(live):
            start = np.cumsum(live) - live
            best = np.minimum.reduceat(rank, start)
            if (done := best == NONE).any():
                weight = np.add.reduceat(self.weight[sym], start)
                out[owner[done]] = weight[done]
                stay = np.repeat(~done, live)
                sym, rank, owner, live, best = sym[stay], rank[stay], owner[~done], live[~done], best[~done]
                if not len(live):
                    break
                start = np.cumsum(live) - live
            hit = np.flatnonzero(rank == np.repeat(best, live))
            seq = np.repeat(np.arange(len(live)), live)[hit]
            at = hit[np.concatenate([[True], seq[1:] != seq[:-1]])]  # leftmost of each sequence
            sym[at] = merged[find(sym[at], sym[at + 1])]
            end = start + live - 1
            more, less = at + 1 < end, at > start
            rank[at] = NONE
            a, b = at[more], at[less]
            rank[a] = ranks[find(sym[a], sym[a + 2])]
            rank[b - 1] = ranks[find(sym[b - 1], sym[b])]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, rank, live = sym[keep], rank[keep], live - 1
        return out


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """``keep`` columns with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        n = counter(path).counts(texts)
        return {
            "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array(n > limit, pa.bool_()),
        }

    return map_texts(docs, text, keep, "n_bytes long, n_tokens long, over_limit boolean", rows)
