"""Readers for exon coordinates: feature text and GFF rows joined with sequences."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions.residues import col, reverse_complement


def parse_join(feature) -> Column:
    """``join(1..5,9..12)`` to an array of half-open 0-based ranges."""
    spans = F.regexp_extract_all(col(feature), F.lit(r"\d+\.\.\d+"), F.lit(0))
    return F.transform(
        spans,
        lambda x: F.struct(
            (F.split(x, r"\.\.")[0].cast("int") - 1).alias("l"), F.split(x, r"\.\.")[1].cast("int").alias("r")
        ),
    )


def read_gff(spark, path: str) -> DataFrame:
    """CDS rows of a GFF3/GTF file: ``(seq_id, gene, l, r, strand)``."""
    return parse_gff(spark.read.text(path))


_GENE = ["seq_id", "gene", "strand", "l", "r"]


def _fields(lines: pa.Array) -> pa.RecordBatch:
    """CDS lines of a GFF3/GTF text as ``_GENE`` columns; comments and other features are left out."""
    lines = lines.filter(pc.invert(pc.starts_with(lines, "#")), null_selection_behavior="drop")
    parts = pc.split_pattern(lines, "\t")
    parts = parts.filter(pc.equal(pc.ascii_lower(pc.list_element(parts, 2)), "cds"))
    seq, low, high, strand, about = (pc.list_element(parts, i) for i in (0, 3, 4, 6, 8))
    named = [pc.struct_field(pc.extract_regex(about, f"{x}"), "g") for x in ("Parent=(?P<g>[^;]+)", 'gene_id "(?P<g>[^"]+)"')]
    l, r = (pc.cast(pc.utf8_trim_whitespace(x), pa.int32()) for x in (low, high))
    return pa.RecordBatch.from_arrays([seq, pc.coalesce(*named, about), strand, pc.subtract_checked(l, pa.scalar(1, pa.int32())), r], _GENE)


def parse_gff(rows: DataFrame) -> DataFrame:
    """The same from lines in a column ``value``."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (_fields(b.column(0)).select(["seq_id", "gene", "l", "r", "strand"]) for b in batches)

    return rows.select("value").mapInArrow(parse, "seq_id string, gene string, l int, r int, strand string")


_LISTS = "seq_id string, gene string, strand string, l array<int>, r array<int>"


def _together(batch: pa.RecordBatch) -> pa.RecordBatch:
    codes = [batch.column(k).dictionary_encode("encode").indices.to_numpy() for k in _GENE[:3]]
    first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in codes], axis=0)])[: batch.num_rows])
    offsets = pa.array(np.append(first, batch.num_rows).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, batch.column(k)) for k in _GENE[3:]]
    return pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(first)) for k in _GENE[:3]] + lists, _GENE)


def neighbours_together(gff: DataFrame) -> DataFrame:
    """Exons of one gene in consecutive rows as lists ``(seq_id, gene, strand, l, r)``; a gene whose rows lie apart has several."""
    return gff.select(*_GENE).mapInArrow(lambda batches: map(_together, batches), _LISTS)


def gff_genes(rows: DataFrame) -> DataFrame:
    """``neighbours_together`` of the lines in a column ``value``, in one step."""
    return rows.select("value").mapInArrow(lambda batches: (_together(_fields(b.column(0))) for b in batches), _LISTS)


def spliced(text, exons) -> Column:
    """The ranges of a text put together, in one pass: SQL's substring counts every range from the start of the text."""

    def cut(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        flat = ranges.flatten()
        l, r = (flat.field(i).to_pylist() for i in (0, 1))
        out, at = [], 0
        for s, n in zip(texts, ranges.value_lengths().to_pylist()):
            n, s = n or 0, s.as_py()
            out.append(None if s is None else "".join(map(s.__getitem__, map(slice, l[at : at + n], r[at : at + n]))))
            at += n
        return pa.array(out, pa.string())

    return F.arrow_udf(cut, "string")(col(text), col(exons))


def gene_structured(gff: DataFrame, seqs: DataFrame) -> DataFrame:
    """Join exons with their sequence: spliced coding sequence and its feature text."""
    return genes_with_sequence(neighbours_together(gff), seqs)


def genes_with_sequence(lists: DataFrame, seqs: DataFrame) -> DataFrame:
    """The same from lists of exons.

    Exons of one gene are gathered (bounded by the gene), neighbours before they are
    shuffled; the sequence is joined once per gene, and minus-strand genes are reverse
    complemented.
    """
    g = lists.groupBy("seq_id", "gene", "strand").agg(F.flatten(F.collect_list(F.arrays_zip("l", "r"))).alias("exons"))
    g = g.withColumn("exons", F.sort_array("exons"))
    from strandframe.sinks.formats import cds_join

    text = cds_join("exons")
    d = g.join(seqs.select("seq_id", "s"), "seq_id").select("seq_id", "gene", "strand", text.alias("text"), spliced("s", "exons").alias("cds"))
    return d.select(
        "seq_id", "gene", F.when(F.col("strand") == "-", F.concat(F.lit("complement("), "text", F.lit(")"))).otherwise(F.col("text")).alias("feature"),
        F.when(F.col("strand") == "-", reverse_complement("cds")).otherwise(F.col("cds")).alias("cds"),
    )


_RANGE, _BLANK = re.compile(r"([0-9]+)\.\.([0-9]+)"), re.compile(r"[\s<>]+", re.ASCII)


def parse_structure(entry) -> Column:
    """``struct(minus, exons)`` of the ``;C`` lines of an entry's text: they are one feature text together, ``complement`` is the minus strand; other lines don't matter."""

    def parse(entries: pa.Array) -> pa.Array:
        minus, sizes, ends = [], [0], array("i")
        for e in entries:
            e = e.as_py()
            text = _BLANK.sub("", "".join(x[2:] for x in e.split("\n") if x.startswith(";C"))) if e is not None else ""
            minus.append(None if e is None else text.startswith("complement"))
            found = _RANGE.findall(text)
            ends.extend(map(int, chain.from_iterable(found)))
            sizes.append(sizes[-1] + len(found))
        both = np.frombuffer(ends, np.int32).reshape(-1, 2) if ends else np.zeros((0, 2), np.int32)
        ranges = pa.StructArray.from_arrays([pa.array(both[:, 0] - 1), pa.array(both[:, 1])], ["l", "r"])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), ranges, mask=entries.is_null())
        return pa.StructArray.from_arrays([pa.array(minus, pa.bool_()), lists], ["minus", "exons"])

    return F.arrow_udf(parse, "minus boolean, exons array<struct<l:int,r:int>>")(col(entry))
