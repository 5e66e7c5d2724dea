"""The tokenizer operators against the public libraries, text by text."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from strandframe.llm import byte_bpe, piece_counts, token_files
from strandframe.llm.registry import table
from strandframe.llm.tokenizer_queries import op2_byte_bpe, op5_token_counts, op10_token_files
from tests.llm.conftest import SF, rows_of

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_byte_bpe_query(spark, odd_dir, library, where):
    sf = odd_dir if where == "odd" else SF
    want = Counter()
    for r in rows_of(sf):
        ids = library.encode_ordinary(r["text"] or "")
        raw = library.decode_bytes(ids)
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()] += 1
        assert raw == (r["text"] or "").encode()
    got = op2_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert Counter(map(tuple, got.collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Ethe'sd1 \n\t.!é²日😀_")), max_size=80))
def test_byte_bpe_any_text(text):
    c = byte_bpe.coder(RANKS, P.PATTERN)
    ranks = {t: i for t, i in c.tokens.items()}
    lib = test_byte_bpe_any_text.__dict__.setdefault("lib", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    ids, n = c.encode([text, "", text])
    assert ids.tolist() == lib.encode_ordinary(text) * 2 and n[1] == 0
    assert c.decode(ids).tobytes() == text.encode() * 2


def test_byte_bpe_other_pattern_and_emptied_table(library):
    c = byte_bpe.ByteBpe(RANKS, r"\s+|\S+", keep=3)
    other = tiktoken.Encoding("o", pat_str=r"\s+|\S+", mergeable_ranks=c.tokens, special_tokens={})
    for t in ("the cat sat", "on  the mat", " and that's that "):
        assert c.encode([t])[0].tolist() == other.encode_ordinary(t)


def test_encoded_arrays_keep_columns(spark, odd_dir, library):
    d = byte_bpe.encoded(table(spark, odd_dir, "documents"), RANKS, P.PATTERN, keep=("doc_id", "lang", "text"), decoded="raw")
    for r in d.collect():
        assert bytes(r["raw"]).decode() == (r["text"] or "") and r["ids"] == library.encode_ordinary(r["text"] or "")


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_token_counts_query(spark, odd_dir, where):
    sf = odd_dir if where == "odd" else SF
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(sp.encode(r["text"] or "", num_threads=1)), n > 4096) for r in rows_of(sf))
    got = op5_token_counts(spark, sf).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert Counter(map(tuple, got.collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Ethes \n\t.é日▁😀ﬁ")), max_size=60))
def test_token_counts_any_text(text):
    sp = test_token_counts_any_text.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")))
    c = piece_counts.counter(P.path("piece_bpe_32k.model"))
    assert c.counts([text]).tolist() == [len(sp.encode(text))]


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_token_files_query(spark, odd_dir, where):
    sf = odd_dir if where == "odd" else SF
    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = Counter()
    for r in rows_of(sf):
        ids = tk.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = [r.asDict() for r in op10_token_files(spark, sf).collect()]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    start = 0
    order = sorted(got, key=lambda r: r["start"])
    for r in order:
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in order]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_token_files_arrays_and_word_tokenizer(spark, odd_dir):
    from strandframe.session import shared_folder

    docs = table(spark, odd_dir, "documents")
    path = P.path("word_bpe_49k.json")
    folder = f"{shared_folder(spark)}/tokens-test"
    manifest = token_files.write_tokens(docs, path, folder)
    tk = Tokenizer.from_file(path)
    want = Counter((r["doc_id"], tuple(tk.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in rows_of(odd_dir))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in token_files.read_tokens(manifest, folder, arrays=True).collect()) == want


def test_empty_tables(spark, empty_dir):
    for q in (op2_byte_bpe, op5_token_counts, op10_token_files):
        assert q(spark, empty_dir).collect() == []


def test_clashing_columns(spark, odd_dir):
    docs = table(spark, odd_dir, "documents").withColumnRenamed("lang", "n_tokens")
    assert "n_tokens" in byte_bpe.digests(docs, RANKS, P.PATTERN).columns
    with pytest.raises(ValueError):
        byte_bpe.digests(docs, RANKS, P.PATTERN, keep=("doc_id", "n_tokens"))
