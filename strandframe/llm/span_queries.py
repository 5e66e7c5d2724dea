"""Queries of the span operators over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm import pii, secrets, spans as S
from strandframe.llm.registry import corpus_query, table


def digest(found, base):
    counts = [S.counted("found", k).alias(f"n_{k}") for k in base]
    return found.select(
        "doc_id", *counts, F.sha2(S.listed(S.of_kinds("found", base)), 256).alias("base_sha256"), S.listed(F.col("found")).alias("spans"),
        F.size("found").cast("long").alias("n_spans"), F.array_max(F.transform("found", lambda s: s["score"])).alias("top_score"),
    )


@corpus_query()
def op3_personal_data(spark, sf_dir):
    return digest(pii.personal_data(table(spark, sf_dir, "documents")), pii.BASE)


@corpus_query()
def op4_secrets(spark, sf_dir):
    return digest(secrets.secrets(table(spark, sf_dir, "documents")), secrets.BASE)
