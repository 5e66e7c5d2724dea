"""Flat token files: unsigned ids, 64-bit document offsets, a manifest with prefix-summed bases.

Documents are dealt by ranges of ``(id, hash of the text)`` and sorted, so the
files in order of ``part`` hold the ids in ascending document order.  A part is
three files named by a token of its own for each attempt of the task that
writes it, so a repeated or speculative attempt never touches another's files:

* ``*.tokens``  ids, little-endian, 16 bits if the vocabulary fits, else 32
* ``*.offsets`` 64-bit offsets of the documents in the part, and the end
* ``*.docs``    64-bit document ids; the smallest 64-bit integer stands for null

The manifest names the files of the attempt that counted and is checkpointed.
Its ``token_base`` and ``doc_base`` are prefix sums over the parts.  Readers map
a part's files into memory (through the file system's reads where the folder is
no local path) and take one part per task.

Defined results: null and empty texts hold the end id alone; repeated ids keep
all their rows, in order of the texts' hash; an empty table gives no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from tokenizers import Tokenizer

from strandframe.llm.batches import ChunkCoder, text_slices
from strandframe.llm.byte_bpe import KNOWN, gathered, splitter
from strandframe.session import cut_lineage, shared_folder

NULL_ID = -(2**63)
#: Ids in memory at once when a part is read.
BLOCK = 4_000_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class FileTokenizer(ChunkCoder):
    """Ids of the tokenizers library for a tokenizer file.

    For a byte-level one, the merges of the library's model run once per distinct
    pre-token; texts that hold an added token, and all texts of other tokenizers,
    go through the library whole.
    """

    def __init__(self, path: str, keep: int = 900_000):
        import json

        super().__init__(keep)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            spec["model"].get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.model, self.letters, self.cut = self.whole.model, byte_letters(), splitter(KNOWN)
        self.end = 1 + max(self.whole.get_vocab_size(with_added_tokens=True) - 1, 0)

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [self.cut(s) for s in strings]
        words = {w: i for i, w in enumerate({w for p in pieces for w in p})}
        ids = [[t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.array([x for p in ids for x in p], np.int32)
        return gathered(pieces, words, np.cumsum(size) - size, size, flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = [i for i, t in enumerate(texts) if not self.plain or any(a in t for a in self.added)]
        if not special:
            return super().encode(texts)
        odd = set(special)
        flat, n = super().encode(["" if i in odd else t for i, t in enumerate(texts)])
        parts = np.split(flat, np.cumsum(n)[:-1])
        for i in special:
            parts[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_TOKENIZERS: dict[str, FileTokenizer] = {}


def tokenizer(path: str) -> FileTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = FileTokenizer(path)
    return _TOKENIZERS[path]


def with_end(flat: np.ndarray, n: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end`` after each document."""
    return np.insert(flat, np.cumsum(n), end) if len(n) else flat, n + 1


def write_tokens(docs: DataFrame, path: str, folder: str, text: str = "text", doc: str = "doc_id", end: int = 2) -> DataFrame:
    """Write the files of all documents to ``folder``, a URI that all executors reach; the manifest.

    Manifest: ``part, files, width, n_docs, n_tokens, doc_base, token_base``, one row for each part with documents.
    """
    if dict(docs.dtypes)[doc] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"the files hold 64-bit whole numbers as document ids; {doc} is {dict(docs.dtypes)[doc]}")
    size = Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    width = 2 if max(size, end + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"{base}/{part:06d}-{uuid.uuid4().hex}"
        t = tokenizer(path)
        n_docs, n_tokens, files = 0, 0, None
        for b in batches:
            ids = b.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8")
            for first, texts in text_slices(b.column(1)):
                if files is None:
                    store.create_dir(base, recursive=True)
                    files = [store.open_output_stream(f"{name}.{kind}") for kind in ("tokens", "offsets", "docs")]
                    files[1].write(np.zeros(1, "<i8").tobytes())
                flat, n = with_end(*t.encode(texts), end)
                files[0].write(flat.astype(f"<u{width}").tobytes())
                files[1].write((n_tokens + np.cumsum(n)).astype("<i8").tobytes())
                files[2].write(ids[first : first + len(texts)].tobytes())
                n_docs, n_tokens = n_docs + len(texts), n_tokens + int(n.sum())
        if files is not None:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "files": [name], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    rows = docs.select(F.col(doc).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"), F.xxhash64(text).alias("_h"))
    rows = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h").select("_id", "_text")
    parts = cut_lineage(rows.mapInArrow(run, "part long, files string, n_docs long, n_tokens long"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per part, not per document
    base = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c.replace("n_", "").rstrip("s") + "_base") for c in ("n_docs", "n_tokens")]
    return parts.select("part", "files", F.lit(width).alias("width"), "n_docs", "n_tokens", *base)


def _mapped(store: fs.FileSystem, name: str, kind: str) -> np.ndarray:
    """A file as an array: mapped where the store is local, else read."""
    if isinstance(store, fs.LocalFileSystem):
        size = store.get_file_info(name).size
        return np.memmap(name, kind, "r") if size else np.zeros(0, kind)
    with store.open_input_file(name) as f:
        return np.frombuffer(f.read(), kind)


def read_tokens(manifest: DataFrame, folder: str, arrays: bool = False) -> DataFrame:
    """Documents from the files: ``doc_id, start, n_tokens, ids_crc32``, and with ``arrays`` also ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for r in b.to_pylist():
                ids, at, doc = (_mapped(store, f"{r['files']}.{k}", t) for k, t in (("tokens", f"<u{r['width']}"), ("offsets", "<i8"), ("docs", "<i8")))
                first = 0
                while first < len(doc):
                    last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
                    block, bounds = ids[at[first] : at[last]].astype("<u4"), at[first : last + 1] - at[first]
                    out = {
                        "doc_id": pa.array([None if d == NULL_ID else d for d in doc[first:last].tolist()], pa.int64()),
                        "start": pa.array(np.asarray(at[first:last]) + r["token_base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(block[x:y]) for x, y in zip(bounds[:-1], bounds[1:])], pa.int64()),
                    }
                    if arrays:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(block.astype(np.int32), pa.int32()))
                    yield pa.RecordBatch.from_pydict(out)
                    first = last

    n = max(1, manifest.count())
    made = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if arrays else "")
    return manifest.select("part", "files", "width", "token_base").repartition(n, "part").mapInArrow(run, made)


def round_trip(docs: DataFrame, path: str, text: str = "text", doc: str = "doc_id", end: int = 2) -> DataFrame:
    """Write all documents to a new folder of the shared one and read them back."""
    folder = f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, path, folder, text, doc, end), folder)
