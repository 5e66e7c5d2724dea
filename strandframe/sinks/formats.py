"""Output formats as column expressions: one string column per line or record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandframe.functions.residues import col


def gff3_cds(exons: DataFrame, prefix: str = "doc", source: str = "text") -> DataFrame:
    phase = (3 - F.col("cds_l") % 3) % 3
    return exons.select(
        F.concat_ws(
            "\t", F.concat(F.lit(prefix), F.col("id").cast("string")), F.lit(source), F.lit("cds"), (F.col("l") + 1).cast("string"),
            F.col("r").cast("string"), F.lit("."), F.lit("+"), phase.cast("string"),
            F.concat(F.lit("ID=cds"), F.col("id").cast("string"), F.lit("."), F.col("exon_no").cast("string"), F.lit(f";Parent={prefix}"), F.col("id").cast("string")),
        ).alias("line")
    )


def bed12(loci: DataFrame, prefix: str = "doc") -> DataFrame:
    first, last = F.col("exons")[0]["l"], F.element_at("exons", -1)["r"]
    name = F.concat(F.lit(prefix), F.col("id").cast("string"))
    sizes = F.array_join(F.transform("exons", lambda e: (e["r"] - e["l"]).cast("string")), ",")
    starts = F.array_join(F.transform("exons", lambda e: (e["l"] - F.col("exons")[0]["l"]).cast("string")), ",")
    return loci.select(
        F.concat_ws("\t", name, first.cast("string"), last.cast("string"), name, F.lit("0"), F.lit("+"), first.cast("string"), last.cast("string"),
                    F.lit("0"), F.size("exons").cast("string"), sizes, starts).alias("line")
    )


def cds_join(exons) -> Column:
    parts = F.transform(col(exons), lambda e: F.concat((e["l"] + 1).cast("string"), F.lit(".."), e["r"].cast("string")))
    return F.concat(F.lit("join("), F.array_join(parts, ","), F.lit(")"))


def cigar(exons) -> Column:
    """Matches for exons, skips for introns."""
    ex = col(exons)
    following = F.slice(ex, F.lit(2), F.size(ex))
    parts = F.zip_with(
        ex, following,
        lambda e, n: F.concat((e["r"] - e["l"]).cast("string"), F.lit("M"), F.coalesce(F.concat((n["l"] - e["r"]).cast("string"), F.lit("N")), F.lit(""))),
    )
    return F.array_join(parts, "")


def fasta(name: Column, s: Column, width: int = 60) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), fold(s, width))


def fold(s: Column, width: int) -> Column:
    return F.array_join(F.regexp_extract_all(s, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")


def phylip_row(name: Column, s: Column) -> Column:
    return F.concat(F.rpad(name, 10, " "), s)


def embl(name: Column, s: Column) -> Column:
    """ID line, sequence header, blocks of ten per line of sixty and a terminator."""
    blocks = F.transform(
        F.regexp_extract_all(s, F.lit(".{1,60}"), F.lit(0)),
        lambda line: F.concat(F.lit("     "), F.array_join(F.regexp_extract_all(F.lower(line), F.lit(".{1,10}"), F.lit(0)), " ")),
    )
    head = F.concat(F.lit("ID   "), name, F.lit("; SV 1; linear; XXX; "), F.length(s).cast("string"), F.lit(" BP.\nSQ   Sequence "), F.length(s).cast("string"), F.lit(" BP;\n"))
    return F.concat(head, F.array_join(blocks, "\n"), F.lit("\n//"))


def genbank(name: Column, s: Column) -> Column:
    lines = F.transform(
        F.regexp_extract_all(s, F.lit(".{1,60}"), F.lit(0)),
        lambda line, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(line), F.lit(".{1,10}"), F.lit(0)), " ")),
    )
    head = F.concat(F.lit("LOCUS       "), name, F.lit(" "), F.length(s).cast("string"), F.lit(" bp\nDEFINITION  derived entry\nORIGIN\n"))
    return F.concat(head, F.array_join(lines, "\n"), F.lit("\n//"))


def nbrf(name: Column, s: Column) -> Column:
    return F.concat(F.lit(">P1;"), name, F.lit("\nderived entry\n"), fold(s, 60), F.lit("*"))


def structure_lines(exons, minus: Column, width: int = 60) -> Column:
    """The exons of an entry as ``;C`` lines, wrapped after commas."""
    text = cds_join(exons)
    whole = F.when(minus, F.concat(F.lit("complement("), text, F.lit(")"))).otherwise(text)
    parts = F.regexp_extract_all(whole, F.lit(f".{{1,{width}}}(?:,|$)|[^,]+,?"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit(";C "), p)), "\n")
