"""Runs, exons and GFF lines read by kernels over Arrow batches, against plain Python."""

import re

from pyspark.sql import functions as F

from strandframe.functions import runs as U
from strandframe.operators import genes as G
from strandframe.sources import genes as S

TEXTS = [None, "", "--", "a", "ab cd", " é ab-ü", "a\U0001F600bc d", "x1yz\n\nq", "ABC", "ü"]


def plain(s):
    return [m.span() for m in re.finditer("[A-Za-z]+", s or "")]


def test_runs_count_code_points_and_stay_in_their_row(spark, monkeypatch):
    monkeypatch.setattr(U, "PIECE", 4)
    d = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    got = dict(map(tuple, d.select("id", U.runs("text")).collect()))
    assert got[0] is None and {i: [tuple(x) for x in got[i]] for i in range(1, len(TEXTS))} == {i: plain(s) for i, s in enumerate(TEXTS) if i}
    want, sets = [], []
    for i, s in enumerate(TEXTS):
        done, whole = 0, sum(r - l for l, r in plain(s))
        for k, (l, r) in enumerate(plain(s), 1):
            want.append((i, k, l, r, done, done + r - l))
            done += r - l
            if done < whole:
                sets.append((i, done, whole))
    assert sorted(map(tuple, G.exons(d, "id").collect())) == want
    rows = d.select(F.col("id").alias("msa_id"), F.lit(0).alias("member"), F.lit("x").alias("role"), F.col("text").alias("a"))
    assert sorted(map(tuple, G.intron_sets(rows).select("msa_id", "pos", "cds_len").collect())) == sets
    introns = [(i, a[1], b[0]) for i, s in enumerate(TEXTS) for a, b in zip(plain(s), plain(s)[1:])]
    assert sorted(map(tuple, G.introns(d, "id").select("id", "l", "r").collect())) == introns


def test_lines_of_a_gene_travel_together(spark):
    line = "{}\tt\tCDS\t{}\t{}\t.\t{}\t0\tID=c;Parent={}".format
    rows = ["#x", line("s", 1, 2, "+", "g"), line("s", 5, 6, "+", "g"), line("s", 3, 4, "-", "h"), "s\tt\tgene\t1\t9\t.\t+\t.\tID=g", line("s", 8, 8, "+", "g"), 'u\tt\tcds\t 1\t3\t.\t+\t0\tgene_id "k"; x']
    d = spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1)
    lists = S.gff_genes(d)
    assert [tuple(x) for x in lists.collect()] == [("s", "g", "+", [0, 4], [2, 6]), ("s", "h", "-", [2], [4]), ("s", "g", "+", [7], [8]), ("u", "k", "+", [0], [3])]
    seqs = spark.createDataFrame([("s", "AéCGTTAGG"), ("u", "ACGT")], "seq_id string, s string")
    got = sorted(map(tuple, S.genes_with_sequence(lists, seqs).collect()))
    assert got == [("s", "g", "join(1..2,5..6,8..8)", "AéTTG"), ("s", "h", "complement(join(3..4))", "CG"), ("u", "k", "join(1..3)", "ACG")]
    assert sorted(map(tuple, S.gene_structured(S.parse_gff(d), seqs).collect())) == got


def test_structure_lines_of_odd_entries(spark):
    entries = [None, "", ">e\n;C join(1..2,\r\n;C 5..<9)\nACGT", ">e\n;C complement( 3..4 )\n;M 7..8", "x ;C 1..2"]
    d = spark.createDataFrame(list(enumerate(entries)), "id long, e string").select("id", S.parse_structure("e").alias("x")).select("id", "x.minus", "x.exons")
    got = {r[0]: (r[1], r[2] and [tuple(e) for e in r[2]]) for r in d.collect()}
    assert got == {0: (None, None), 1: (False, []), 2: (False, [(0, 2), (4, 9)]), 3: (True, [(2, 4)]), 4: (False, [])}
