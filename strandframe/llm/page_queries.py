"""Query of the HTML extraction over all pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm import site_tree
from strandframe.llm.registry import corpus_query, table


@corpus_query()
def op11_site_tree(spark, sf_dir):
    found = site_tree.extract(table(spark, sf_dir, "pages"))
    return found.select("_page.page_id", "_page.url", "text", F.length("text").cast("long").alias("n_chars"))
