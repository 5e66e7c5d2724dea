"""File-source stream of FASTA entries with stateless lookup against a static word table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandframe.functions import residues as R
from strandframe.sources.records import parse_entries


def read_fasta_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """``(name, s, molc)`` of every entry of every new file."""
    raw = (
        spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).schema("value string").format("text").load(folder)
    )
    entry = F.concat(F.lit(">"), F.regexp_replace(F.trim("value"), "^>", ""))
    return parse_entries(raw.select(entry.alias("entry")), "entry").select("name", "s", R.molecule_type("s").alias("molc"))


def match_stream(entries: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """Words of arriving entries that a static ``(word, q_id)`` table holds."""
    return entries.select("name", F.explode(R.kmers("s", k)).alias("word")).join(words, "word")


def run_to_folder(stream: DataFrame, path: str, checkpoint: str):
    """Process what has arrived and stop; the checkpoint lets the next run go on from there."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
