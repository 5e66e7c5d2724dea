"""Gene structures: exon and intron tables from run boundaries, intron sets of aligned members.

A text is a locus, its letter runs are exons and what lies between them are
introns.  All ranges are worked out inside the row, by a kernel over Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandframe.functions import runs as U


def exon_arrays(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """Exon ranges of every text that has any, as one array per row."""
    return df.filter(F.col(text).rlike(U.LETTER)).select(F.col(ident).alias("id"), U.runs(text).alias("exons"))


def exons(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """``(id, exon_no, l, r, cds_l, cds_r)``: half-open genomic and coding ranges, numbers from 1."""
    return U.run_table(df.select(F.col(ident).alias("id"), F.col(text).alias("text")), "text", "id").select("id", F.col("no").cast("int").alias("exon_no"), "l", "r", "cds_l", "cds_r")


def introns(df: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """Intron between consecutive exons of a text with the codon phase it interrupts."""
    d = df.select(F.col(ident).alias("id"), F.col(text).alias("text"))
    return U.run_table(d, "text", "id").filter("next IS NOT NULL").select(
        "id", F.col("no").cast("int").alias("intron_no"), F.col("r").alias("l"), F.col("next").alias("r"), F.col("cds_r").alias("pos"), (F.col("cds_r") % 3).alias("phase"))


def intron_sets(rows: DataFrame) -> DataFrame:
    """``(msa_id, member, role, pos, cds_len)``: coding positions interrupted in every member."""
    d = U.run_table(rows, "a", "msa_id", "member", "role")
    return d.filter("cds_r < cds_len").select("msa_id", "member", "role", F.col("cds_r").alias("pos"), "cds_len")


def set_distance(sets: DataFrame) -> DataFrame:
    """(a + b - 2c) / (a + b) between members 2k and 2k+1 from one aggregate per pair."""
    d = sets.select("msa_id", F.floor(F.col("member") / 2).alias("pair"), (F.col("member") % 2).alias("side"), "pos")
    per = d.groupBy("msa_id", "pair", "pos").agg(F.max((F.col("side") == 0).cast("int")).alias("a"), F.max((F.col("side") == 1).cast("int")).alias("b"))
    g = per.groupBy("msa_id", "pair").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("c"))
    return g.withColumn("dist", (F.col("a") + F.col("b") - 2 * F.col("c")) / (F.col("a") + F.col("b")).cast("double"))
