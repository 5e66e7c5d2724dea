"""Guess costs against every segmentation, the corpus dictionary against a plain count, contexts, planted values."""

import random
import re
import string
from collections import Counter
from functools import cache

import pytest

from strandframe.llm import secrets


def plain_words(texts):
    """The dictionary of a corpus, text by text."""
    count = Counter()
    for t in texts:
        found = set()
        for w in re.findall(r"[^\W\d_]+", secrets.CONTEXT.sub(" ", t or "")):
            if 4 <= len(w) <= 24 and w[1:].islower() and len(w.lower()) == len(w):
                found.add(w.lower())
        count.update(found)
    kept = [(n, w) for w, n in count.items() if n >= secrets.LEAST_DOCS]
    return [w for n, w in sorted(kept, key=lambda x: (-x[0], x[1].encode()))[: secrets.MOST_WORDS]]


def exhaustive(value, rater):
    """Least cost over all segmentations."""
    low = value.lower()

    @cache
    def best(j):
        if j == 0:
            return 0.0
        return min([best(j - 1) + 1.0] + [best(i) + rater.part(value[i:j], low[i:j]) + (0.3 if i else 0.0) for i in range(j - 1)])

    return round(best(len(value)), 3)


def test_cost_is_the_least_of_all_segmentations():
    rng = random.Random(9)
    rater = secrets.Rater(["zwischenzeit", "haus", "ñandú"])
    parts = ["pass", "word", "1999", "qwe", "aaa", "abab", "Zwischenzeit", "Haus", "ñandú", "x", "$", "2021-04-05", "p4ssw0rd"]
    for _ in range(400):
        v = "".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice(string.printable[:80]) for _ in range(rng.randint(1, 4)))[:16]
        assert rater.cost(v) == pytest.approx(exhaustive(v, rater)), v


def test_dictionary_of_a_corpus(spark):
    texts = [None, "", "Haus und Garten HAUS Häuser mañana"] + ["Das Haus", "ein Haus password: garten", "zum haus", "Haus!", "mañana Haus", "mañana", "Mañana x", "la mañana", "MAÑANA", "DeR gaRTen"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = secrets.common_words(docs)
    assert got == plain_words(texts) == ["haus", "mañana"]
    assert secrets.common_words(docs.limit(0)) == [] and secrets.common_words(docs, least=1, most=1) == ["haus"]


PROSE = "Massachusetts internationalization overwhelmingly Zwischenzeit Geschwindigkeit selbstverständlich completamente dictionary nécessairement acontecimiento".split()


def test_learned_words_are_no_secrets(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + " ".join(PROSE)) for i in range(6)] + [(9, "the password is Geschwindigkeit today"), (10, "password is kqzvhwtnbmrp now")], "doc_id long, text string")
    found = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in secrets.secrets(docs).collect()}
    assert found[9] == [] and found[10] == ["guess"]
    rater = secrets.Rater(secrets.common_words(docs))
    assert all(secrets.find(f"the password is {w} to us", rater) == [] for w in PROSE)


@pytest.mark.parametrize("text,kinds", [
    ("Authorization: Bearer q8Zk2LwPx9vTn4Rb", ["bearer"]), ("see https://bob:Zk8qLw2xPv@host/ now", ["url"]), ("https://bob:password1@host/", []), ("use ghp_" + "a1B2" * 9, ["token"]),
    ("-----BEGIN RSA PRIVATE KEY-----\nMIIEpAIBAAK\nabc=\n-----END RSA PRIVATE KEY-----\nafter", ["key"]), ("-----BEGIN PRIVATE KEY-----\nMIIEpAIBAAK", ["key"]), ("the bearer of bad news", []), ("", []),
])
def test_contexts(text, kinds):
    assert [k for k, *_ in secrets.find(text)] == kinds
    if "after" in text:
        (_, a, b, _), = secrets.find(text)
        assert text[b:] == "\nafter" and a == 0


def test_planted_values():
    """Recall of random values and precision on ordinary ones, in every context."""
    rng = random.Random(21)
    contexts = ["password: {}", "pwd={}", "the secret is {}", "login: {}.", "Authorization: Bearer {}", "ftp://u:{}@h/x"]
    chars = string.ascii_letters + string.digits
    hit = sum(bool(secrets.find(c.format("".join(rng.choices(chars, k=14))))) for c in contexts for _ in range(50))
    rater = secrets.Rater([w.lower() for w in PROSE])
    false = sum(any(k not in secrets.BASE for k, *_ in secrets.find(c.format(w), rater)) for c in contexts[:4] for w in PROSE)
    print("recall", hit / 300, "false", false / (4 * len(PROSE)))
    assert hit == 300 and false == 0
