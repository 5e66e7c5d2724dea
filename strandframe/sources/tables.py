"""The driver's parquet tables and the sequence views derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.functions import residues as R


class Tables:
    """Lazy access to ``<sf_dir>/<name>.parquet`` and derived views.

    ``seqs``   one letters-only upper-case sequence per document
    ``nts``    the same text projected on the four-letter nucleotide alphabet
    ``rows``   one aligned row per conversation turn: non-letters are gaps
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return self.documents.select("doc_id", "text", "lang", "source")

    @cached_property
    def seqs(self) -> DataFrame:
        return self.docs.select(F.col("doc_id").alias("seq_id"), "lang", "source", R.letters("text").alias("s"))

    @cached_property
    def nts(self) -> DataFrame:
        return self.docs.select(
            F.col("doc_id").alias("seq_id"), "lang", "source", R.nucleotide(R.letters("text")).alias("s")
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("q_id"), R.letters("text").alias("s"))

    @cached_property
    def rows(self) -> DataFrame:
        """MSA rows: ``(msa_id, member, role, a)`` with gap character ``-``."""
        return self.conversations.select(
            F.col("conv_id").alias("msa_id"), F.col("turn").alias("member"), "role", R.aligned("text").alias("a")
        )

    @cached_property
    def cells(self) -> DataFrame:
        """One row per residue or internal gap of an aligned row, sites from 1."""
        return self.rows.select(
            "msa_id", "member", "role", F.posexplode(F.split("a", "")).alias("p", "r")
        ).filter("r != ''").select("msa_id", "member", "role", (F.col("p") + 1).cast("long").alias("site"), "r")
