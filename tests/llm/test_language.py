"""Language identification: held-out accuracy, calibration, edges."""

import re

import numpy as np
import pytest

from strandframe.llm import language_id as L
from strandframe.llm.language_queries import op1_language_id
from strandframe.llm.registry import table
from tests.llm.conftest import held_out, rows_of

BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def result(spark):
    return {r["doc_id"]: r for r in op1_language_id(spark, BIG).collect()}


def test_held_out_accuracy_and_calibration(result):
    rows = [r for r in rows_of(BIG) if r["lang"] and held_out(r["doc_id"])]
    assert all(result[r["doc_id"]]["held_out"] for r in rows) and len(rows) > 100
    right = [result[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]
    scores = [result[r["doc_id"]]["score"] for r in rows]
    print(np.mean(right), np.mean(scores), min(scores))
    assert np.mean(right) > 0.95 and abs(np.mean(right) - np.mean(scores)) < 0.05


def test_every_document_once(result):
    rows = rows_of(BIG)
    assert len(result) == len(rows)
    for r in rows:
        g = result[r["doc_id"]]
        assert (g["lang_pred"] == L.UND) == (r["text"] is None or not any(c.isalpha() for c in r["text"])) and 0 <= g["score"] <= 1


def test_odd_rows(spark, odd_dir, empty_dir):
    got = op1_language_id(spark, odd_dir).collect()
    assert len(got) == len(rows_of(odd_dir))
    for r in got:
        assert r["lang_pred"] in ("en", "de", L.UND) and r["held_out"] == (r["doc_id"] is None or held_out(r["doc_id"]))
    assert op1_language_id(spark, empty_dir).collect() == []
    docs = table(spark, odd_dir, "documents")
    none = L.predict(docs, L.train(docs.filter("lang = 'xx'"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {(L.UND, 0.0)}


def test_label_is_no_input(spark, odd_dir):
    docs = table(spark, odd_dir, "documents")
    m = L.train(docs)
    a = L.predict(docs, m).select("lang_pred", "score").collect()
    b = L.predict(docs.withColumnRenamed("lang", "other"), m).select("lang_pred", "score").collect()
    assert a == b


def test_fit_is_sparse_and_temperature_helps():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        c = int(rng.integers(3))
        at = np.unique(np.append(rng.integers(100, 2000, 30), c))
        rows.append((c, at, np.ones(len(at)) / np.sqrt(len(at))))
    w, b = L.fit(rows, 3, l1=0.5)
    assert (w == 0).mean() > 0.97 and all(w[k].argmax() == k for k in range(3))
    logits = np.array([x @ w[at] + b for _, at, x in rows])
    assert (logits.argmax(axis=1) == [c for c, _, _ in rows]).mean() > 0.95
    y = np.array([0, 1] * 50)
    z = np.stack([np.where(y == 0, 9, 0), np.where(y == 1, 9, 0)], axis=1).astype(float)
    z[::5] = z[::5, ::-1]  # a fifth is wrong with great confidence
    assert abs(L.softmax(z / L.calibrate(z, y)).max(axis=1).mean() - 0.8) < 0.02


def test_codes():
    assert L._codes("A b-c!").tolist() == [0, 97, 0, 98, 0, 99, 0]
    assert not L._codes("12 !?").any() and not L._codes("").any()
    assert re.fullmatch("[a-z]+", L.UND)
