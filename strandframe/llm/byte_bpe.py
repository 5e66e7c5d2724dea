"""Byte-level BPE: merges over length-bucketed padded matrices, encoding and decoding.

Each match of the split pattern (a pre-token) is encoded on its own.  Distinct
pre-tokens of a batch are put, by length, into padded matrices of token ids.  In
every round each row merges its leftmost pair of minimum rank; ranks come from a
hashed pair table, rows without a mergeable pair leave the matrix, and the matrix
loses one column.  The number of rows in a matrix follows its width.  Only a
pre-token longer than ``WIDEST`` bytes, for which a matrix costs the square of its
length, takes a heap over its pairs instead; the merges are the same.

Defined results: null and empty texts have no tokens; rows are independent, so
repeated ids and rows are encoded each for itself; other columns pass through the
operator when asked for.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandframe.llm.batches import ChunkCoder, gathered, map_texts

#: Upper lengths of the matrices' buckets, in bytes; cells of a matrix at once.
WIDTHS, CELLS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 3072, 4096), 3_200_000
WIDEST = WIDTHS[-1]
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing table from a pair of token ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray, size: int):
        self.size = np.int64(size)
        keys = left.astype(np.int64) * self.size + right
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            claim = np.flatnonzero(free)
            self.keys[slot[claim]] = keys[todo[claim]]  # of several on one slot the last stays
            won = self.keys[slot] == keys[todo]
            self.rank[slot[won]], self.merged[slot[won]] = rank[todo[won]], merged[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slot of every pair; a slot with rank ``NONE`` where the pair is in no token."""
        keys = left.astype(np.int64) * self.size + right
        slot = self._slot(keys)
        for _ in range(self.probes):
            at = self.keys[slot]
            miss = np.flatnonzero((at != keys) & (at != -1))
            if not len(miss):
                break
            slot[miss] = (slot[miss] + 1) & self.mask
        bad = self.keys[slot] != keys
        if bad.any():
            slot[bad] = self._empty
        return slot

    def known(self) -> dict[tuple[int, int], tuple[int, int]]:
        """All pairs as a plain dictionary, made when it is first asked for."""
        if not hasattr(self, "_plain"):
            at = np.flatnonzero(self.keys >= 0)
            left, right = (self.keys[at] // self.size).tolist(), (self.keys[at] % self.size).tolist()
            self._plain = dict(zip(zip(left, right), zip(self.rank[at].tolist(), self.merged[at].tolist())))
        return self._plain

    @property
    def _empty(self) -> int:
        if not hasattr(self, "_hole"):
            self._hole = int(np.flatnonzero(self.keys == -1)[0])
        return self._hole


def merge_pairs(tokens: dict[bytes, int]) -> PairTable:
    """All pairs of tokens whose bytes together are a token, ranked by its rank."""
    left, right, whole = [], [], []
    for t, r in tokens.items():
        for k in range(1, len(t)):
            a, b = tokens.get(t[:k]), tokens.get(t[k:])
            if a is not None and b is not None:
                left.append(a), right.append(b), whole.append(r)
    w = np.array(whole, np.int32)
    return PairTable(np.array(left, np.int64), np.array(right, np.int64), w, w, max(tokens.values()) + 1)


def heap_merge(ids: list[int], find) -> list[int]:
    """Merge one long sequence: always the leftmost pair of minimum rank.  ``find((a, b))`` gives (rank, merged) or None."""
    n = len(ids)
    ids, nxt, prv = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(p[0], i, ids[i], ids[i + 1], p[1]) for i in range(n - 1) if (p := find((ids[i], ids[i + 1])))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j] = merged, False
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
            if p := find((merged, ids[nxt[j]])):
                heapq.heappush(heap, (p[0], i, merged, ids[nxt[j]], p[1]))
        if prv[i] >= 0 and (p := find((ids[prv[i]], merged))):
            heapq.heappush(heap, (p[0], prv[i], ids[prv[i]], merged, p[1]))
    return [x for x, ok in zip(ids, alive) if ok]


#: The split pattern of the public rank files, and the same for texts whose letters, numbers and spaces `re` sees alike.
KNOWN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"


def splitter(pattern: str):
    """``findall`` of a pattern; for the known one by `re` where both engines agree on every character of a Latin text."""
    whole = regex.compile(pattern).findall
    if pattern != KNOWN:
        return whole
    latin = "".join(map(chr, range(0x250)))
    pairs = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    odd = set().union(*(set(regex.findall(a, latin)) ^ set(re.findall(b, latin)) for a, b in pairs))
    differs = re.compile("[" + re.escape("".join(sorted(odd))) + "\u0250-\U0010ffff]").search
    fast = re.compile(FAST).findall
    return lambda text: whole(text) if differs(text) else fast(text)


class ByteBpe(ChunkCoder):
    """Encoder and decoder for one rank file; ``pattern`` splits texts into pre-tokens.

    A space before a character that isn't white space always begins a pre-token
    of the public pattern, so chunks at single spaces are encoded apart.  For
    another pattern every text is split by that pattern as a whole.
    """

    def __init__(self, path: str, pattern: str, keep: int = 900_000):
        super().__init__(keep)
        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.cut, self.chunks = splitter(pattern), pattern == KNOWN
        self.pairs = merge_pairs(self.tokens)
        self.byte = np.array([self.tokens[bytes([b])] for b in range(256)], np.int32)
        by_id = sorted((i, t) for t, i in self.tokens.items())
        self.length = np.zeros(by_id[-1][0] + 1, np.int64)
        self.length[[i for i, _ in by_id]] = [len(t) for _, t in by_id]
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.pool = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

    def keys(self, text: str) -> list[str]:
        return super().keys(text) if self.chunks else [self.key(s) for s in self.cut(text)]

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self.cut(s) for s in strings] if self.chunks else [[s] for s in strings]
        words = list(dict.fromkeys(chain.from_iterable(pieces)))
        ids, size = self.merge([w.encode() for w in words])
        return gathered(pieces, dict(zip(words, range(len(words)))), np.cumsum(size) - size, size, ids)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pre-tokens in a row, and the number of each; none is empty."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        count = np.ones(len(words), np.int64)
        whole = np.fromiter(map(self.tokens.get, words, repeat(-1)), np.int64, len(words))
        rows, found = [np.flatnonzero(whole >= 0)], [whole[whole >= 0]]
        for i in np.flatnonzero((whole < 0) & (sizes > WIDEST)):
            found.append(np.array(heap_merge(self.byte[np.frombuffer(words[i], np.uint8)].tolist(), self.pairs.known().get), np.int64))
            rows.append(np.full(len(found[-1]), i))
            count[i] = len(found[-1])
        for low, high in zip((0, *WIDTHS), WIDTHS):
            group = np.flatnonzero((whole < 0) & (sizes > low) & (sizes <= high))
            for part in np.split(group, range(CELLS // high, len(group), CELLS // high)) if len(group) else ():
                m, n = self._matrix([words[i] for i in part], sizes[part], high)
                rows.append(np.repeat(part, n))
                found.append(m[np.arange(m.shape[1]) < n[:, None]])
                count[part] = n
        row = np.concatenate(rows)
        return np.concatenate(found)[np.argsort(row, kind="stable")].astype(np.int32), count

    def _matrix(self, words: list[bytes], sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded rows of final ids, and the length of each row."""
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        m, live, place, col = self.byte[raw], sizes.copy(), np.arange(len(words)), np.arange(width)
        out, length = np.zeros((len(words), width), np.int32), sizes.copy()
        find, ranks = self.pairs.find, self.pairs.rank
        rank = ranks[find(m[:, :-1].ravel(), m[:, 1:].ravel())].reshape(len(words), width - 1)
        rank[col[1:] >= sizes[:, None]] = NONE
        while len(m):
            row = np.arange(len(m))
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(m), np.int64)
            go = rank[row, at] != NONE if rank.shape[1] else np.zeros(len(m), bool)
            if not go.all():  # finished rows leave
                out[place[~go], : m.shape[1]], length[place[~go]] = m[~go], live[~go]
                m, rank, live, place, at, row = m[go], rank[go], live[go], place[go], at[go], row[: go.sum()]
                if not len(m):
                    break
            whole = self.pairs.merged[find(m[row, at], m[row, at + 1])]
            w = m.shape[1] - 1
            m = np.where(col[:w] <= at[:, None], m[:, :-1], m[:, 1:])
            m[row, at] = whole
            rank = np.where(col[: w - 1] < at[:, None], rank[:, :-1], rank[:, 1:]) if w > 1 else rank[:, :0]
            live = live - 1
            a, b = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < live)
            rank[a, at[a] - 1] = ranks[find(m[a, at[a] - 1], whole[a])]
            rank[b, at[b]] = ranks[find(whole[b], m[b, at[b] + 1])]
            last = np.flatnonzero((at + 1 >= live) & (at < w - 1))
            rank[last, at[last]] = NONE
        return out, length

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens as one array."""
        size = self.length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.offset[ids] - ends + size, size) + np.arange(total)]


_CODERS: dict[tuple, ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """The coder of this worker process; its table of known pre-tokens is bounded by ``keep``."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``keep`` columns with ``ids`` (array of int) and, if named, the bytes decoded from them (binary)."""

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        c = coder(path, pattern)
        flat, n = c.encode(texts)
        out = {ids: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat, pa.int32()))}
        if decoded:
            ends = np.cumsum(n)
            out[decoded] = pa.array([c.decode(flat[e - k : e]).tobytes() for e, k in zip(ends, n)], pa.binary())
        return out

    return map_texts(docs, text, keep, f"{ids} array<int>" + (f", {decoded} binary" if decoded else ""), rows)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens``, ``n_bytes`` and SHA-256 of ids (unsigned 32-bit, little-endian) and of the decoded bytes.

    Encodes and decodes as ``encoded`` does, but leaves only digests, so that ids needn't travel.
    """

    def rows(texts: list[str]) -> dict[str, pa.Array]:
        c = coder(path, pattern)
        flat, n = c.encode(texts)
        flat = flat.astype("<u4")
        raw = c.decode(flat)
        size = np.concatenate([[0], np.cumsum(c.length[flat])])
        e = np.concatenate([[0], np.cumsum(n)])
        b = size[e]
        return {
            "n_tokens": pa.array(n, pa.int64()),
            "n_bytes": pa.array(np.diff(b), pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(flat[x:y]).hexdigest() for x, y in zip(e[:-1], e[1:])], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(b[:-1], b[1:])], pa.string()),
        }

    return map_texts(docs, text, keep, "n_tokens long, n_bytes long, ids_sha256 string, decoded_sha256 string", rows)
