"""Sequence flat files: format detection, record splitting, parsing and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandframe.functions.residues import col

# First characters of an entry by format, tried in this order.
FORMAT_PREFIX = [
    ("GenBank", "LOCUS"), ("EMBL", "ID   "), ("ProDB", "CODE "), ("PIR", "ENTRY"), ("NBRF", ">P1;"), ("NBRF", ">DL;"),
    ("NEXUS", "#NEXUS"), ("MSF", "!!"), ("FASTA", ">"),
]


def detect_format(line) -> Column:
    """Format of an entry from its first line that is not a ``;`` comment; ``Bare`` when none fits."""
    first = F.regexp_extract(col(line), r"^(?:;[^\n]*\n)*([^\n]*)", 1)
    out = F
    for name, prefix in FORMAT_PREFIX:
        out = out.when(first.startswith(prefix), F.lit(name))
    return out.otherwise(F.lit("Bare"))


def entry_name(entry, fmt) -> Column:
    e = col(entry)
    return (
        F.when(fmt == "GenBank", F.regexp_extract(e, r"LOCUS\s+(\S+)", 1))
        .when(fmt == "EMBL", F.regexp_extract(e, r"ID\s+([^\s;]+)", 1))
        .when(fmt == "NBRF", F.regexp_extract(e, r">..;(\S+)", 1))
        .when(fmt == "FASTA", F.regexp_extract(e, r">\s*(\S+)", 1))
    )


def entry_residues(entry, fmt) -> Column:
    """Residues of an entry: the part after the header, letters and gaps only, upper case."""
    e = F.regexp_replace(col(entry), r"(?m)^;.*\n?", "")
    body = (
        F.when(fmt == "GenBank", F.regexp_extract(e, r"(?s)ORIGIN[^\n]*\n(.*)", 1))
        .when(fmt == "EMBL", F.regexp_extract(e, r"(?s)\nSQ[^\n]*\n(.*)", 1))
        .when(fmt == "NBRF", F.regexp_extract(e, r"(?s)^[^\n]*\n[^\n]*\n(.*)", 1))
        .when(fmt == "FASTA", F.regexp_extract(e, r"(?s)^[^\n]*\n(.*)", 1))
        .otherwise(e)
    )
    return F.upper(F.regexp_replace(body, "[^A-Za-z-]", ""))


def parse_entries(df: DataFrame, entry: str, *keys: str) -> DataFrame:
    d = df.withColumn("fmt", detect_format(entry))
    return d.select(*keys, "fmt", entry_name(entry, F.col("fmt")).alias("name"), entry_residues(entry, F.col("fmt")).alias("s"))


def read_flat_file(spark: SparkSession, path: str, fmt: str = "FASTA") -> DataFrame:
    """Entries of a (possibly gzipped) flat file, split at record boundaries by the text reader."""
    sep = {"FASTA": "\n>", "NBRF": "\n>", "GenBank": "\n//", "EMBL": "\n//"}[fmt]
    raw = spark.read.option("lineSep", sep).text(path)
    # what stands before the first entry may be comment lines only
    text = F.trim(F.regexp_replace(F.regexp_replace("value", r"(?m)^;.*\n?", ""), r"^\s*\n", ""))
    if sep == "\n>":
        text = F.when(text != "", F.concat(F.lit(">"), F.regexp_replace(text, "^>", "")))
    entries = raw.select(text.alias("entry")).filter(F.length("entry") > 1)
    return parse_entries(entries, "entry")


def parse_ranges(spec) -> Column:
    """``3-22,41-100`` (1-based, inclusive) to an array of half-open 0-based ranges."""
    return F.transform(
        F.split(col(spec), ","),
        lambda x: F.struct((F.split(x, "-")[0].cast("int") - 1).alias("l"), F.split(x, "-")[1].cast("int").alias("r")),
    )


def splice(s, ranges) -> Column:
    """Concatenate the slices of ``s`` named by a range array."""
    return F.array_join(F.transform(col(ranges), lambda x: col(s).substr(x["l"] + 1, x["r"] - x["l"])), "")


def suffix_number(text) -> Column:
    """``12k``, ``3M`` or ``1.5G`` to a number."""
    c = col(text)
    value = F.regexp_extract(c, r"^[0-9.]+", 0).cast("double")
    unit = F.lower(F.regexp_extract(c, r"([A-Za-z]?)$", 1))
    return value * F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9).otherwise(1.0)
