"""Words as numbers and counts of six frames, against plain loops."""

import random
from collections import Counter

from strandframe.functions import codons as C, runs as U
from strandframe.operators import composition as K, word_join as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frame_words_are_counted_before_they_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(U, "PIECE", 50)
    rng = random.Random(3)
    texts = [None, "", "ACGTAC"] + ["".join(rng.choices("ACGT", k=rng.randrange(1, 70))) for _ in range(25)]
    d = spark.createDataFrame([(x,) for x in texts], "s string").coalesce(2)
    amino, want = C.code_string(1), Counter()
    for s in filter(None, texts):
        for strand, x in (("+", s), ("-", s[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            for f in range(3):
                p = "".join(amino[C.codon_index(x[i : i + 3])] for i in range(f, len(x) - 2, 3))
                want.update((strand, f, p[i : i + 2]) for i in range(len(p) - 1) if "*" not in p[i : i + 2])
    got = K.frame_word_counts(d, 2)
    assert {(r.strand, r.frame, r.word): r.n for r in got.collect()} == want and "Generate" not in plan(got)


def test_places_and_counts_of_words_longer_than_one_number(spark, monkeypatch):
    monkeypatch.setattr(U, "PIECE", 64)
    rng = random.Random(4)
    base = "".join(rng.choices("ABZ", k=60))
    texts = [None, "", "AZ", base, base[5:40] + "QQ" + base[20:50]] + ["".join(rng.choices("AZ", k=rng.randrange(60))) for _ in range(10)]
    d = spark.createDataFrame(list(enumerate(texts)), "seq_id long, s string").coalesce(2)
    places = sorted(tuple(r)[:2] for r in J.word_places(d, "seq_id", 14, "dp").collect())
    assert places == [(i, p) for i, s in enumerate(texts) for p in range(len(s or "") - 13)]
    counts = J.coded_counts(d, "seq_id", 3)
    want = Counter((i, len(s) - 2, n) for i, s in enumerate(texts) if s for n in Counter(s[p : p + 3] for p in range(len(s) - 2)).values())
    assert Counter((r.seq_id, r.total, r.n) for r in counts.collect()) == want
    q = spark.createDataFrame([(0, base)], "q_id long, s string")
    for k in (3, 14):
        full = set()
        for i, s in enumerate(texts):
            for a in range(len(base)):
                for b in range(len(s or "")):
                    if base[a] == s[b] and (not a or not b or base[a - 1] != s[b - 1]):
                        n = 0
                        while a + n < len(base) and b + n < len(s) and base[a + n] == s[b + n]:
                            n += 1
                        if n >= k:
                            full.add((0, i, a + 1, b + 1, n))
        assert set(map(tuple, J.diagonal_matches(q, d, k).select("q_id", "seq_id", "q_start", "d_start", "len").collect())) == full


def test_seeded_alignment_finds_its_matches_once(spark, monkeypatch):
    """Chains are read by three branches and alignments by two; each used to search all texts again."""
    from strandframe.plans import QUERIES
    from strandframe.plans import search_queries as Q

    cuts = []
    monkeypatch.setattr(Q, "cut_lineage", lambda df, cut=Q.cut_lineage: cuts.append(1) or cut(df))
    d = QUERIES["seeded_alignment"](spark, "/root/testdata/sf0.001")
    assert len(cuts) == 2 and "FlatMapGroupsInPandas" not in plan(d)


def test_chains_are_dealt_over_tasks(spark):
    """One row a pair and many pairs a call: a call a pair, all in one task where the matches are few bytes, took most of the time."""
    from strandframe.operators import chaining as C

    hits = spark.createDataFrame([(i % 5, i, 1 + 20 * j, 1 + 21 * j, 14) for i in range(300) for j in range(2)], "q_id long, seq_id long, q_start long, d_start long, len long")
    d = C.chains(hits)
    assert "FlatMapGroupsInPandas" not in plan(d) and d.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, d.collect())) == sorted((i % 5, i, 24.9, j + 1, 1 + 20 * j, 1 + 21 * j, 14) for i in range(300) for j in range(2))


def test_seeded_alignments_read_texts_once(spark):
    from strandframe.operators import chaining as C

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    x = "ACDEFGHIKLMNPQRSTVWY"
    queries = spark.createDataFrame([(1, "WW" + x + "CC" + x)], "q_id long, s string")
    seqs = spark.createDataFrame([(2, "A" + x + "C" + x + "GG"), (3, x)], "seq_id long, s string").mapInArrow(counted, "seq_id long, s string")
    members = spark.createDataFrame([(1, 2, 1, 3, 2, 20), (1, 2, 2, 25, 23, 20), (1, 3, 1, 3, 1, 20)], "q_id long, seq_id long, k long, q_start long, d_start long, len long")
    got = {r.seq_id: r for r in C.seeded_alignments(members, queries, seqs).collect()}
    assert got[2].cigar in ("20M1M1D20M", "20M1D1M20M") and got[2].score == 40 * 4 + 4 - 11 and got[3].cigar == "20M"
    assert (got[2].s1, got[2].s2) == (x + "CC" + x, x + "C" + x) and (got[2].q_l, got[2].q_r, got[2].d_l, got[2].d_r) == (3, 44, 2, 42)
    assert read.value == 2
