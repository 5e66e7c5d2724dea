"""De-duplication and decontamination against brute force."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from strandframe.llm import decontaminate, simhash
from strandframe.llm.corpus_queries import op7_decontaminate, op8_simhash
from strandframe.llm.registry import table
from tests.llm.conftest import SF, rows_of

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_classes(prints, ids, radius=2):
    parent = {f: f for f in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= radius:
            parent[root(a)] = root(b)
    least = {}
    for f, d in zip(prints, ids):
        r = root(f)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[root(f)] for f in prints]


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_simhash_query(spark, odd_dir, where):
    rows = rows_of(odd_dir if where == "odd" else SF)
    prints = [brute_print(r["text"]) for r in rows]
    ids = [r["doc_id"] for r in rows]
    want = Counter(zip(ids, (f"{f:016x}" for f in prints), brute_classes(prints, ids)))
    got = op8_simhash(spark, odd_dir if where == "odd" else SF).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == want


def test_simhash_chains_and_hubs(spark):
    import random

    rng = random.Random(5)
    prints, f = [], rng.getrandbits(63)
    for _ in range(120):  # a chain, a full ball and strangers
        f ^= 1 << rng.randrange(63) | 1 << rng.randrange(63)
        prints.append(f)
    hub = rng.getrandbits(63)
    prints += [hub] + [hub ^ (1 << a) ^ (1 << b) for a, b in combinations(range(40), 2)] + [rng.getrandbits(63) for _ in range(50)]
    ids = list(range(len(prints)))
    d = spark.createDataFrame(list(zip(ids, prints)), "doc_id long, fp long")
    got = {r["fp"]: r["label"] for r in simhash.labels(d).collect()}
    want = brute_classes(prints, prints)
    assert [got[f] for f in prints] == want
    deep = simhash.links(d.select("fp").distinct(), 4)
    assert deep.filter("bit_count(u ^ v) > 4").count() == 0
    with pytest.raises(ValueError):
        simhash.links(d, 3)


@pytest.mark.parametrize("where", ["odd", "sf", "empty"])
def test_simhash_keeps_one_of_each(spark, odd_dir, empty_dir, where):
    sf = {"odd": odd_dir, "sf": SF, "empty": empty_dir}[where]
    docs = table(spark, sf, "documents")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = rows_of(sf)
    prints = [brute_print(r["text"]) for r in rows]
    cls = brute_classes(prints, prints)
    want = {}
    for r, f, c in zip(rows, prints, cls):
        k = (r["doc_id"] is None, r["doc_id"] or 0, f - (1 << 64) if f >> 63 else f)
        want[c] = min(k, want.get(c, k))
    got = kept.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(None if k[0] else k[1] for k in want.values())


def test_simhash_empty(spark, empty_dir):
    assert op8_simhash(spark, empty_dir).collect() == []


def brute_hits(text, items, size=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(size, len(v))
        for i in range(len(v) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(str(item) if item is not None else "null")
    return len(w), len(hit), sorted(found)


PLANTED = [
    (1, "One two three four five six seven eight nine ten eleven twelve", "zero ONE two; three four five six seven eight nine ten eleven twelve one two"),
    (2, "a a a a a a a a a a a a", "a a a a a a a a a a a a a b a a a a a a a a a a"),
    (3, "short item", "the short item is short: short ITEM!"),
    (3, "same id again", "same id again"),
    (4, None, None),
    (5, "", ""),
    (None, "nameless words here", "nameless words here"),
    (6, "é è ê", "x é è ê y é è"),
    (7, "one two three four five six seven eight nine ten", "two three four five six seven eight nine ten eleven"),
]


@pytest.mark.parametrize("where", ["planted", "odd", "sf", "blocks"])
def test_decontaminate_query(spark, odd_dir, tmp_path, where, monkeypatch):
    sf = {"odd": odd_dir, "sf": SF}.get(where, str(tmp_path))
    if sf == str(tmp_path):
        pq.write_table(pa.table({"doc_id": pa.array(range(len(PLANTED)), pa.int64()), "text": [d for _, _, d in PLANTED]}), tmp_path / "documents.parquet")
        pq.write_table(pa.table({"item_id": pa.array([i for i, _, _ in PLANTED], pa.int64()), "text": [t for _, t, _ in PLANTED]}), tmp_path / "benchmark.parquet")
    if where == "blocks":
        monkeypatch.setattr(decontaminate, "BLOCK", 7)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()]
    rows = rows_of(sf)[:60] if where == "sf" else rows_of(sf)
    want = Counter()
    for r in rows:
        n, h, found = brute_hits(r["text"], items)
        want[r["doc_id"], n, h, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), h > 0] += 1
    got = Counter(map(tuple, op7_decontaminate(spark, sf).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    assert got == want if where != "sf" else want <= got
    kept = decontaminate.clean(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(k[0] for k in got.elements() if not k[-1])


def test_decontaminate_empty(spark, odd_dir, empty_dir, tmp_path):
    assert op7_decontaminate(spark, empty_dir).collect() == []
    none = decontaminate.contamination(table(spark, odd_dir, "documents"), table(spark, empty_dir, "benchmark"))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(rows_of(odd_dir))
