"""Writers: sorted sequence databases, split flat files, several outputs in one go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_database(seqs: DataFrame, path: str, name: str = "name") -> None:
    """Name-ordered parquet: lookups by name touch few row groups."""
    seqs.repartitionByRange(name).sortWithinPartitions(name).write.mode("overwrite").parquet(path)


def write_split(entries: DataFrame, path: str, by: str, text: Column) -> None:
    """One folder of text files per value of ``by``."""
    entries.select(by, text.alias("value")).write.mode("overwrite").partitionBy(by).option("lineSep", "\n").text(path)


def write_lines(df: DataFrame, path: str, line: Column, compression: str = "none") -> None:
    df.select(line.alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def write_many(df: DataFrame, outputs: dict[str, Column]) -> None:
    """Several text outputs of one result, computed once."""
    kept = df.persist()
    try:
        for path, line in outputs.items():
            write_lines(kept, path, line)
    finally:
        kept.unpersist()


def fixed4(x: Column) -> Column:
    """``x`` as C's ``%.4f`` writes it: its exact binary value is rounded, ties go to the even digit.

    Java rounds the shortest decimal text of ``x`` half up.  Here ``x`` becomes a whole
    number of a power of two that holds all of its bits, and whole-number division gives
    the digits; numbers from 256 on take Java's way.
    """
    a = F.abs(x)

    def digits(low: int, high: int) -> Column:
        """Ten-thousandths of a number from ``2**low`` to below ``2**high``, where it is one."""
        one = F.lit(str(2 ** (52 - low))).cast("decimal(21,0)")
        own = F.when((a >= 2.0**low) & (a < 2.0**high), a * F.lit(2.0 ** (52 - low)))
        wide = own.cast("long").cast("decimal(20,0)") * F.lit(10_000).cast("decimal(5,0)")
        down = F.call_function("div", wide, one)
        twice = (wide - down.cast("decimal(10,0)") * one) * F.lit(2).cast("decimal(1,0)")
        return down + ((twice > one) | ((twice == one) & (down % 2 == 1))).cast("long")

    n = F.coalesce(F.when(a < 2.0**-16, F.lit(0).cast("long")), digits(-16, -8), digits(-8, -2), digits(-2, 8))
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10_000).cast("string"), F.lit("."), F.lpad((n % 10_000).cast("string"), 4, "0"))
    return F.coalesce(text, F.format_string("%.4f", x))


def statistic_line(dist: Column, mch: Column, mmc: Column, gap: Column, unp: Column) -> Column:
    return F.format_string("%8s %6d %6d %6d %6d", fixed4(dist), mch, mmc, gap, unp)
