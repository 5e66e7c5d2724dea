"""Every stage of the pipeline against brute force on its own input, and the whole."""

import base64
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from strandframe.llm import language_id, secrets
from strandframe.llm.registry import table
from tests.llm.test_secret_words import plain_words
from tests.llm.conftest import SF
from tests.llm.test_corpus import brute_classes, brute_hits, brute_print


@pytest.fixture(scope="module", params=["sf", "odd"])
def stages(spark, request, odd_dir, tmp_path_factory):
    sf = SF if request.param == "sf" else odd_dir
    docs, out = table(spark, sf, "documents"), []
    folder = tmp_path_factory.mktemp("stages")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, after))
        docs = after
    return sf, out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(stages):
    _, s = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE encoding and decoding"]
    for before, after in s[:4]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(spark, stages):
    _, s = stages
    before, after = s[0]
    found = language_id.predict(before, language_id.train(before), keep=("doc_id", "text", "lang", "source", "n_chars")).collect()
    want = Counter(tuple(r)[:5] for r in found if r["lang_pred"] != "und" and r["score"] >= 0.5)
    assert Counter(map(tuple, after.collect())) == want
    assert all(any(c.isalpha() for c in r["text"]) for r in rows(after))


def test_near_duplicates(stages):
    before, after = map(rows, stages[1][1])
    prints = [brute_print(r["text"]) for r in before]
    cls = brute_classes(prints, prints)
    kept = Counter(tuple(r.values()) for r in after)
    assert kept <= Counter(tuple(r.values()) for r in before)
    assert len(after) == len(set(cls))
    of = {}
    for r, c in zip(before, cls):
        of.setdefault(c, []).append((r["doc_id"] is None, r["doc_id"] or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == Counter(min(v) for v in of.values())


def test_decontamination(spark, stages):
    sf, s = stages
    before, after = map(rows, s[2])
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    want = Counter(tuple(r.values()) for r in before if not brute_hits(r["text"], items)[1])
    assert Counter(tuple(r.values()) for r in after) == want


def test_secrets(stages):
    before, after = map(rows, stages[1][3])
    rater = secrets.Rater(plain_words([r["text"] for r in before]))
    want = Counter()
    for r in before:
        t, spans = r["text"], secrets.find(r["text"] or "", rater)
        if spans:
            hide, out, at = [False] * len(t), [], 0
            for kind, a, b, _ in sorted(spans, key=lambda x: (x[1], -x[2], x[0])):
                if a >= at:
                    out += [t[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
                hide[a:b] = [True] * (b - a)
            r["text"] = "".join([*out, t[at:]])
            r["n_chars"] = len(r["text"])
            assert sum(hide) > 0
        want[tuple(r.values())] += 1
    assert Counter(tuple(r.values()) for r in after) == want


def test_token_ids(stages):
    before, after = map(rows, stages[1][4])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter((r["doc_id"], r["text"] or "", tuple(lib.encode_ordinary(r["text"] or ""))) for r in before)
    assert Counter((r["doc_id"], r["text"], tuple(r["ids"])) for r in after) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run(spark, stages, empty_dir):
    sf, s = stages
    assert Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == Counter(r["doc_id"] for r in rows(s[-1][1]))
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


NAMES = ["ids", "n_tokens", "score", "lang_pred", "fp", "label", "_text", "_id", "_hash", "_fp", "_n", "_doc", "_keep", "_row", "_spans", "_clean", "words", "len", "shard", "h", "bytes", "kept", "a.b"]


def test_extra_columns_with_any_name(spark, odd_dir):
    """Stages and operators give the same rows when the documents have columns named like what they make."""
    from pyspark.sql import functions as F

    plain = table(spark, odd_dir, "documents")
    extra = plain.select("*", *[F.concat(F.lit("x"), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    for name, f in corpus_pipeline.STAGES:
        a, b = f(spark, plain, odd_dir), f(spark, extra, odd_dir)
        want = extra.columns if name != corpus_pipeline.STAGES[-1][0] else None
        assert want is None or b.columns == want, name
        assert Counter(map(str, a.collect())) == Counter(map(str, b.select(*a.columns).collect())), name
        if want:
            assert all(r[c] == (None if r["doc_id"] is None else f"x{r['doc_id']}") for r in b.collect() for c in NAMES)


def test_operators_with_extra_columns(spark, odd_dir, tmp_path):
    from pyspark.sql import functions as F

    from strandframe.llm.queries import CORPUS

    plain = table(spark, odd_dir, "documents")
    plain.select("*", *[F.lit("x").alias(c) for c in NAMES if c != "a.b"]).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, odd_dir, "benchmark").withColumn("words", F.lit("x")).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("pages", "conversations"):
        t = table(spark, odd_dir, name)
        t.select("*", *[F.lit("x").alias(c) for c in [*NAMES, "host", "noisy", "_page", "_html", "conv", "i", "id", "up", "d", "w", "t", "part"] if c != "a.b" and c not in t.columns]).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, q in CORPUS.items():
        if name != "op10_token_files" and name != "op1_language_id":
            assert Counter(map(str, q(spark, odd_dir).collect())) == Counter(map(str, q(spark, str(tmp_path)).collect())), name
    for name in ("op10_token_files", "op1_language_id"):
        assert CORPUS[name](spark, str(tmp_path)).count() == plain.count()
