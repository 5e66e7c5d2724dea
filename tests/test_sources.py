"""Readers, writers and the stream on small files."""

import gzip

from pyspark.sql import functions as F

from strandframe.sinks import formats as O, writers as W
from strandframe.sources import genes as G, matrices as M, records as I
from strandframe.streaming import ingest


def test_flat_files(spark, tmp_path):
    fa = tmp_path / "a.fa.gz"
    with gzip.open(fa, "wt") as f:
        f.write("; comment\n>one first\nACGT\nAC\n>two\nGG-A\n")
    got = {r.name: r.s for r in I.read_flat_file(spark, str(fa)).collect()}
    assert got == {"one": "ACGTAC", "two": "GG-A"}
    gb = tmp_path / "b.gb"
    gb.write_text("LOCUS       X1 6 bp\nDEFINITION  t\nORIGIN\n        1 acgtac\n//\nLOCUS       X2 3 bp\nORIGIN\n        1 ggg\n//\n")
    assert {r.name: r.s for r in I.read_flat_file(spark, str(gb), "GenBank").collect()} == {"X1": "ACGTAC", "X2": "GGG"}


def test_gene_structured_sequences(spark, tmp_path):
    p = tmp_path / "g.gff"
    p.write_text("##gff\ns1\tx\tCDS\t1\t3\t.\t+\t0\tParent=g1\ns1\tx\tCDS\t7\t9\t.\t+\t0\tParent=g1\ns1\tx\tCDS\t2\t4\t.\t-\t0\tParent=g2\ns1\tx\texon\t1\t9\t.\t+\t.\tParent=g1\n")
    seqs = spark.createDataFrame([("s1", "ACGTTTGGA")], "seq_id string, s string")
    got = {r.gene: (r.feature, r.cds) for r in G.gene_structured(G.read_gff(spark, str(p)), seqs).collect()}
    assert got == {"g1": ("join(1..3,7..9)", "ACGGGA"), "g2": ("complement(join(2..4))", "ACG")}


def test_edges_and_catalog(spark):
    e = spark.createDataFrame([("0.5 3 a b",), (">fasta line",), ("0.1 2 b c",)], "value string")
    assert {(r.u, r.v, r.value) for r in M.edges_from_text(e, "value", 1).collect()} == {("a", "b", 0.5), ("b", "c", 0.1)}
    c = spark.createDataFrame([(1, "x\ny\n\n;skip\nz")], "id int, t string")
    assert sorted((r.grp, r.line) for r in M.catalog_entries(c, "id", "t").collect()) == [(1, "x"), (1, "y"), (2, "z")]


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([("b", "AC", "p"), ("a", "GG", "q")], "name string, s string, kind string")
    W.write_database(d, str(tmp_path / "db"))
    assert spark.read.parquet(str(tmp_path / "db")).filter("name = 'a'").count() == 1
    W.write_split(d, str(tmp_path / "split"), "kind", O.fasta(F.col("name"), F.col("s")))
    assert {r.name: r.s for r in I.read_flat_file(spark, str(tmp_path / "split/kind=p")).collect()} == {"b": "AC"}
    W.write_many(d, {str(tmp_path / "o1"): F.col("name"), str(tmp_path / "o2"): F.col("s")})
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o2")).collect()) == ["AC", "GG"]


def test_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.fa").write_text(">a\nACGTACGT\n>b\nMKVLW\n")
    words = spark.createDataFrame([("CGT", 7)], "word string, q_id int")
    stream = ingest.match_stream(ingest.read_fasta_stream(spark, src), words, 3)
    ingest.run_to_folder(stream, out, ck).awaitTermination(60)
    (tmp_path / "in" / "2.fa").write_text(">c\nCCGT\n")
    ingest.run_to_folder(stream, out, ck).awaitTermination(60)
    assert sorted(r.name for r in spark.read.parquet(out).collect()) == ["a", "a", "c"]


def test_structure_lines(spark):
    from pyspark.sql import functions as F

    from strandframe.sinks.formats import structure_lines
    from strandframe.sources.genes import parse_structure

    rows = [(1, ">a\n;C complement(join(<1..5,\n;C 9..12,\r\n;C 100..>250))\n;M 3\nACGT"), (2, ";C join(7..9)"), (3, ">none\nACGT"), (4, "")]
    got = {r.k: r.x for r in spark.createDataFrame(rows, "k long, t string").select("k", parse_structure("t").alias("x")).collect()}
    assert got[1].minus and [tuple(e) for e in got[1].exons] == [(0, 5), (8, 12), (99, 250)]
    assert not got[2].minus and [tuple(e) for e in got[2].exons] == [(6, 9)] and got[3].exons == [] and got[4].exons == []
    wide = spark.range(1).select(F.expr("transform(sequence(1, 40), i -> struct(cast(i * 1000 as int) as l, cast(i * 1000 + 7 as int) as r))").alias("e"))
    text = wide.select(structure_lines("e", F.lit(True)).alias("t"))
    assert all(len(x) <= 64 and x.startswith(";C ") for x in text.first().t.split("\n"))
    back = text.select(parse_structure("t").alias("x")).first().x
    assert back.minus and [tuple(e) for e in back.exons] == [(i * 1000, i * 1000 + 7) for i in range(1, 41)]
