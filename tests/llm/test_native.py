"""Sharding and line quality: plans without Python, and edges that the SQL check's tables don't have."""

import re
from collections import Counter

import pytest

from strandframe.llm import line_quality as Q, sharding
from strandframe.llm.native_queries import op6_sharding, op9_line_quality
from strandframe.llm.registry import table
from tests.llm.conftest import SF, rows_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python(spark):
    for q in (op6_sharding, op9_line_quality):
        assert not re.search("Python|Pandas|Arrow", plan(q(spark, SF)))


def repeats(words):
    w = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    c = Counter(w)
    return len({i + k for i, x in enumerate(w) if c[x] > 1 for k in range(5)})


@pytest.mark.parametrize("where", ["odd", "sf"])
def test_line_quality(spark, odd_dir, where):
    sf = odd_dir if where == "odd" else SF
    want = Counter()
    for r in rows_of(sf):
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = repeats(w)
        want[r["doc_id"], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)] += 1
    got = op9_line_quality(spark, sf)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect())) == want
    assert got.filter("kept AND base_failed").count() == 0


def test_line_rules_and_clean_text(spark, empty_dir):
    good = "This is a plain sentence of twelve words that nobody would ever want to lose."
    bad = ["Home | About | News | Contact", "© 2020 Some Company. All rights reserved.", "WIN!! NOW!! BIG!!", "%%% $$$ ### a", "Login"]
    d = spark.createDataFrame([(1, good), (2, "\n".join([good, *bad])), (3, "\n".join(bad * 4)), (4, None), (5, " \n\t")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in Q.line_quality(d, clean="left").collect()}
    assert got[1]["kept"] and got[1]["left"] == good == got[2]["left"] and got[2]["n_words"] > 20
    assert not got[3]["kept"] and got[3]["left"] == "" and not got[4]["kept"] and not got[5]["kept"]
    assert op9_line_quality(spark, empty_dir).collect() == []
    with pytest.raises(ValueError):
        Q.line_quality(d.withColumnRenamed("doc_id", "kept"), keep=("kept",))


def test_copyright_with_a_year(spark):
    good = "This is a plain sentence of twelve words that nobody would ever want to lose."
    left = {"(c) 2019 Foo Inc.": "", "Notice (C) 1998 by Bar": "", "(c) the third case is this": "(c) the third case is this", "(c) 3019 Baz": "(c) 3019 Baz"}
    d = spark.createDataFrame([(i, f"{good}\n{x}") for i, x in enumerate(left)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in Q.line_quality(d, clean="left").collect()}
    assert [got[i]["left"] for i in range(4)] == [f"{good}\n{x}".strip() for x in left.values()]
    assert [got[i]["lost"] > 0 for i in range(4)] == [True, True, False, False]


@pytest.mark.parametrize("limit", [1, 300, 4000, 10**9])
def test_shards_fit(spark, odd_dir, limit):
    got = sharding.shards(table(spark, odd_dir, "documents"), limit).collect()
    rows = rows_of(odd_dir)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in rows)
    size, count = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        count[r["shard"]] += 1
    for r in got:
        assert size[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= limit or count[r["shard"]] == 1)
    # only oversized buckets split: a shard's sibling and itself would not fit together
    plain = {s: b for s, b in size.items() if "." not in s}
    for s in plain:
        if s:
            sibling = s[:-1] + "10"[int(s[-1])]
            together = plain[s] + sum(b for x, b in size.items() if x.startswith(sibling))
            assert together > limit


def test_shards_of_repeated_rows(spark, empty_dir):
    d = spark.createDataFrame([(7, "x" * 10)] * 95 + [(7, "y" * 3)] * 5 + [(i, "z") for i in range(50)], "doc_id long, text string").repartition(3)
    got = sharding.shards(d, 40).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
    assert len(got) == 150 and max(size.values()) <= 40 and all(size[r["shard"]] == r["shard_bytes"] for r in got)
    assert op6_sharding(spark, empty_dir).collect() == []
