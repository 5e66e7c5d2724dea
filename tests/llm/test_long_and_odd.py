"""Tokenizers on long pre-tokens, language ID by hand, repeated rows, text ids, what two bits reach."""

import math
import random
import string
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from strandframe.llm import byte_bpe, decontaminate, language_id as L, piece_counts, simhash, token_files
from tests.llm.test_tokenizers import RANKS, library  # noqa: F401

CJK = "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出而要于就下得可你年生自会那后能对着事其里所去行过家十用发天如然作方成者多日都三小军二无同么经法当起与好看学进种将还分此心前面又定见只主没公从"


def long_texts(n):
    rng = random.Random(n)
    return [
        "".join(rng.choices(CJK, k=n)), "".join(rng.choices(string.ascii_letters, k=n)), "https://" + "/".join("".join(rng.choices("abcdef", k=5)) for _ in range(n // 6)),
        "a" * n, "ab" * (n // 2), "".join(rng.choices("éüñß😀", k=n)), "_" * n, "".join(rng.choices("0123456789", k=n)),
    ]


@pytest.mark.parametrize("n", [65, 97, 500, 5000])
def test_long_pre_tokens(library, n):  # noqa: F811
    texts = long_texts(n)
    c = byte_bpe.ByteBpe(RANKS, P.PATTERN)
    ids, size = c.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [library.encode_ordinary(t) for t in texts]
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert piece_counts.PieceCounter(path).counts(texts).tolist() == [len(sp.encode(t)) for t in texts]


def test_heap_is_for_the_longest_only(monkeypatch):
    calls = []
    for m in (byte_bpe, piece_counts):
        monkeypatch.setattr(m, "heap_merge", lambda ids, find: calls.append(len(ids)) or ids)
    byte_bpe.ByteBpe(RANKS, P.PATTERN).encode(long_texts(1000))
    piece_counts.PieceCounter(P.path("piece_bpe_32k.model")).counts(long_texts(1000))
    assert not [n for n in calls if n <= 4096]


# ---- language ID -----------------------------------------------------------------------------------


def plain_grams(text):
    """Features and counts of a text, n-gram by n-gram."""
    words = "".join(c if c.isalpha() else "\0" for c in text.lower())
    while "\0\0" in words:
        words = words.replace("\0\0", "\0")
    codes = [0, *map(ord, words.strip("\0").replace("\0", "\0")), 0]
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = 0
            for x in codes[i : i + n]:
                h = h * 0x100000001B3 % 2**64 ^ x
            out[(h * 0x9E3779B97F4A7C15 + n * 0xC2B2AE3D27D4EB4F) % 2**64 >> 49 & L.BUCKETS - 1] += 1
    return out


def plain_fit(rows, classes, rate=0.5, beta=1.0, l1=0.002, l2=1e-4, rounds=3):
    z, n = {}, {}

    def w(i, c):
        s = z.get((i, c), 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get((i, c), 0.0))) / rate + l2)

    for _ in range(rounds):
        for label, x in rows:
            x = {**x, "bias": 1.0}
            now = {(i, c): w(i, c) for i in x for c in range(classes)}
            s = [sum(v * now[i, c] for i, v in x.items()) for c in range(classes)]
            e = [math.exp(a - max(s)) for a in s]
            for c in range(classes):
                p = e[c] / sum(e) - (c == label)
                for i, v in x.items():
                    g, k = v * p, (i, c)
                    step = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / rate
                    z[k] = z.get(k, 0.0) + g - step * now[k]
                    n[k] = n.get(k, 0.0) + g * g
    return w


TEXTS = {
    "en": ["the cat sat on the mat", "A dog, and the other dog!", "this is it", "what the house was"],
    "de": ["die Katze sitzt auf der Matte", "der Hund und die Öfen", "das ist es", "was für ein Haus"],
}


def test_language_id_by_hand(spark, monkeypatch):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in TEXTS.items() for t in ts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    whole = L.fit

    def spy(examples, classes):
        seen["rows"], seen["classes"] = examples, classes
        return whole(examples, classes)

    monkeypatch.setattr(L, "fit", spy)
    model = L.train(docs)
    learned = [r for r in docs.filter(L.learnable()).collect()]
    df = Counter(f for r in learned for f in plain_grams(r["text"]))
    for f in range(L.BUCKETS):
        assert math.isclose(model.idf[f], math.log((1 + len(learned)) / (1 + df[f])) + 1)

    def features(text):
        x = {f: (1 + math.log(c)) * model.idf[f] for f, c in plain_grams(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / norm for f, v in x.items()}

    known = [(model.languages.index(r["lang"]), features(r["text"])) for r in learned]
    for label, at, x in seen["rows"]:
        assert any(label == k and set(at.tolist()) == set(f) and all(math.isclose(v, f[i], rel_tol=1e-5) for i, v in zip(at.tolist(), x)) for k, f in known)
    w = plain_fit([(label, dict(zip(at.tolist(), map(float, x)))) for label, at, x in seen["rows"]], 2)
    for c in range(2):
        assert math.isclose(model.bias[c], w("bias", c), abs_tol=1e-6)
        assert all(math.isclose(model.weights[f, c], w(f, c), abs_tol=1e-6) for f in df)
    for r in L.predict(docs, model, keep=("text",)).collect():
        x = features(r["text"])
        s = [(sum(v * w(i, c) for i, v in x.items()) + w("bias", c)) / model.temperature for c in range(2)]
        p = 1 / (1 + math.exp(-abs(s[0] - s[1])))
        assert r["lang_pred"] == model.languages[int(s[1] > s[0])] and math.isclose(r["score"], p, rel_tol=1e-5)


@pytest.mark.parametrize("doc", [1, 2, 6, 9])
def test_repeated_rows_are_one_of_the_sample(spark, monkeypatch, doc):
    rows = [(doc, "over and over", "en")] * 3000 + [(k, f"etwas anderes {k}", "de") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = []
    monkeypatch.setattr(L, "fit", lambda examples, classes: got.append(Counter(c for c, _, _ in examples)) or (np.zeros((L.BUCKETS, classes)), np.zeros(classes)))
    monkeypatch.setattr(L, "calibrate", lambda *a: 1.0)
    m = L.train(docs, sample=20)
    if "en" in m.languages:
        assert got[0][m.languages.index("en")] <= 1
    assert got[0][m.languages.index("de")] <= 20 // len(m.languages) and sum(got[0].values()) >= 8


# ---- ids that are texts, and the reach of two bits ---------------------------------------------------


def test_text_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("b", " ".join(words)), ("a", " ".join(words)), (None, " ".join(words[::-1])), (None, " ".join(words[::-1])), ("c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert Counter(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == Counter(["a", None, "c"])
    items = spark.createDataFrame([(1, " ".join(words[5:20]))], "item_id long, text string")
    assert Counter(r["doc_id"] for r in decontaminate.clean(docs, items).collect()) == Counter([None, None, "c"])
    with pytest.raises(ValueError, match="whole numbers"):
        token_files.write_tokens(docs, P.path("byte_bpe_50k.json"), "file:///nowhere")


def test_recall_by_similarity():
    """Share of near copies within two bits, by the similarity of their word shingles."""
    rng = random.Random(4)
    found = {}
    for like in (0.8, 0.9, 0.98):
        hits = 0
        for _ in range(60):
            words = [f"w{rng.randrange(5000)}" for _ in range(600)]
            edits = round((1 - like) / (1 + like) * 600 / 3)  # one changed word changes three shingles
            other = list(words)
            for i in rng.sample(range(600), edits):
                other[i] = f"x{rng.randrange(5000)}"
            a, b = (simhash.fingerprint(" ".join(w), 3) % 2**64 for w in (words, other))
            hits += (a ^ b).bit_count() <= 2
        found[like] = hits / 60
    print(found)
    assert found[0.8] < 0.2 and found[0.98] > found[0.8]
