"""Language identification over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm import language_id as L
from strandframe.llm.registry import corpus_query, table


@corpus_query()
def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = L.predict(docs, L.train(docs))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
