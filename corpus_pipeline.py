"""The corpus pipeline: language, one of each near-duplicate, no benchmark passages, no secrets, then token ids.

Every stage takes ``(spark, docs, sf_dir)`` and gets what its predecessor kept,
written and read again.  All but the last return the columns of ``documents``.

Defined results: a document without letters, or whose best language has a score
under ``LEAST_SCORE``, goes in the first stage (texts of null or no letter too);
of a class of near-duplicates the smallest id stays; documents with any benchmark
window go; secrets (by a dictionary of the stage's own documents) become ``[KIND]`` and ``n_chars`` follows; the last stage adds
``ids`` and ``n_tokens`` and holds the text decoded from them.  Extra columns of any
name pass through unchanged; in the last stage ``ids`` and ``n_tokens`` replace theirs.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.llm import byte_bpe, decontaminate, language_id, secrets, simhash
from strandframe.llm.batches import packed
from strandframe.llm.registry import table
from strandframe.session import shared_folder, ship_package

ROOT = os.path.dirname(os.path.abspath(__file__))
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with some confidence."""
    ship_package(spark, ROOT)
    found = language_id.predict(docs.select(packed(docs), "text"), language_id.train(docs), keep=("_doc",))
    return found.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: copies, and texts within two of 64 bits (half of the pairs at similarity 0.98, none at 0.9)."""
    ship_package(spark, ROOT)
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    ship_package(spark, ROOT)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    ship_package(spark, ROOT)
    found = secrets.secrets(docs.select(packed(docs), "text"), keep=("_doc",), name="_spans", clean="_clean")
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    own = {c: F.col(f"_doc.`{c}`") for c in docs.columns}
    return found.select(*[F.when(F.size("_spans") > 0, new[c]).otherwise(v).alias(c) if c in new else v.alias(c) for c, v in own.items()])


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text that they decode to."""
    ship_package(spark, ROOT)
    coded = byte_bpe.encoded(docs.select(packed(docs), "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("_doc",), decoded="_raw")
    keep = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("text", "ids", "n_tokens")]
    return coded.select(*keep, "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("_raw").cast("string").alias("text"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: Trained weights, XXH64 and merges have no SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again."""
    ship_package(spark, ROOT)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
