"""Sample statistics per group: moments, histograms, ranks and the Dixon outlier test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.session import cut_lineage

# Critical ratios of the two-sided Dixon test at the 0.05 level, n = 3..100.
DIXON_05 = [
    0.9411, 0.7651, 0.6423, 0.5624, 0.5077, 0.5539, 0.5114, 0.4778, 0.5018, 0.4740, 0.4519, 0.4327, 0.4162, 0.4015,
    0.3889, 0.3779, 0.3682, 0.3590, 0.3511, 0.3436, 0.3369, 0.3302, 0.3245, 0.3191, 0.3143, 0.3095, 0.3052, 0.3012,
    0.2972, 0.2937, 0.2904, 0.2870, 0.2838, 0.2810, 0.2783, 0.2757, 0.2728, 0.2705, 0.2682, 0.2660, 0.2638, 0.2619,
    0.2599, 0.2582, 0.2560, 0.2542, 0.2525, 0.2508, 0.2494, 0.2476, 0.2464, 0.2446, 0.2433, 0.2418, 0.2405, 0.2392,
    0.2379, 0.2365, 0.2354, 0.2341, 0.2329, 0.2320, 0.2308, 0.2299, 0.2290, 0.2279, 0.2268, 0.2260, 0.2249, 0.2238,
    0.2231, 0.2221, 0.2215, 0.2206, 0.2199, 0.2189, 0.2180, 0.2174, 0.2164, 0.2160, 0.2151, 0.2143, 0.2137, 0.2131,
    0.2123, 0.2117, 0.2110, 0.2102, 0.2097, 0.2091, 0.2084, 0.2079, 0.2072, 0.2068, 0.2061, 0.2056, 0.2049, 0.2044,
]


def extremes(df: DataFrame, keys: list[str], ident: list[str], value: str) -> DataFrame:
    """Three smallest and three largest values per group with the group size.

    Only the outer ranks leave each task (rank limits are pushed below the
    shuffle), so a huge group costs no more than a small one.
    """
    def side(order, prefix):
        w = W.partitionBy(*keys).orderBy(*order)
        d = df.select(*keys, *ident, value).withColumn("rk", F.row_number().over(w)).filter("rk <= 3")
        picks = [F.max(F.when(F.col("rk") == i, F.col(value))).alias(f"{prefix}{i}") for i in (1, 2, 3)]
        who = F.max(F.when(F.col("rk") == 1, F.struct(*ident))).alias(f"{prefix}_id")
        return d.groupBy(*keys).agg(*picks, who)

    low = side([F.col(value), *ident], "lo")
    high = side([F.col(value).desc(), *ident], "hi")
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.join(low, keys).join(high, keys)


def dixon(df: DataFrame, keys: list[str], ident: list[str], value: str, critical=DIXON_05, parity: bool = False, min_range: float = 0.0) -> DataFrame:
    """One pass of the ratio test: at most one low and one high outlier per group.

    ``critical`` holds the ratios for n = 3, 4, ...; groups beyond its end use
    its last value (the built-in one ends at n = 100, as the published table does).

    Ratios are r10 for n <= 7, r11 for n <= 10 and r21 above.  ``parity``
    keeps the published program's variants: the upper ratio is zero for
    n = 8..10, and for n >= 11 the lower one uses the full range and the upper
    one the nearest neighbour.
    """
    e = extremes(df, keys, ident, value)
    n, lo1, lo2, lo3, hi1, hi2, hi3 = (F.col(c) for c in ("n", "lo1", "lo2", "lo3", "hi1", "hi2", "hi3"))

    def ratio(num, den):
        return F.when(den > min_range, num / den).otherwise(F.lit(0.0))

    low = F.when(n <= 7, ratio(lo2 - lo1, hi1 - lo1)).when(n <= 10, ratio(lo2 - lo1, hi2 - lo1)).otherwise(
        ratio(lo3 - lo1, (hi1 if parity else hi2) - lo1)
    )
    high = F.when(n <= 7, ratio(hi1 - hi2, hi1 - lo1)).when(
        n <= 10, F.lit(0.0) if parity else ratio(hi1 - hi2, hi1 - lo2)
    ).otherwise(ratio(hi1 - (hi2 if parity else hi3), hi1 - lo2))
    thr = F.element_at(F.array(*[F.lit(float(x)) for x in critical]), (F.least(n, F.lit(len(critical) + 2)) - 2).cast("int"))
    d = e.filter("n > 2").withColumn("low", low).withColumn("high", high).withColumn("thr", thr)
    out = F.filter(
        F.array(
            F.when(F.col("high") >= thr, F.struct(F.lit("high").alias("side"), F.col("hi_id").alias("id"), hi1.alias("value"), F.col("high").alias("ratio"))),
            F.when(F.col("low") >= thr, F.struct(F.lit("low").alias("side"), F.col("lo_id").alias("id"), lo1.alias("value"), F.col("low").alias("ratio"))),
        ),
        lambda x: x.isNotNull(),
    )
    return d.select(*keys, "n", F.inline(out)).select(*keys, "n", "side", "id.*", "value", "ratio")


def dixon_recursive(df: DataFrame, keys: list[str], ident: list[str], value: str, **options) -> DataFrame:
    """Repeat the test on the rest of each group that had an outlier until none is left."""
    found, rest = [], df.select(*keys, *ident, value)
    while True:
        hits = cut_lineage(dixon(rest, keys, ident, value, **options))
        if hits.isEmpty():
            break
        found.append(hits)
        groups = hits.select(*keys).distinct()
        rest = cut_lineage(rest.join(groups, keys, "left_semi").join(hits.select(*keys, *ident), [*keys, *ident], "left_anti"))
    return reduce(DataFrame.unionByName, found) if found else dixon(df, keys, ident, value, **options).limit(0)


def histogram(df: DataFrame, value, low: float, high: float, bins: int, transform=None) -> DataFrame:
    """Counts per equal-width bin of an optionally transformed value; outer bins collect the rest."""
    x = transform(value) if transform else value
    return df.groupBy(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_per_group(df: DataFrame, keys: list[str], order, limit: int) -> DataFrame:
    """Best ``limit`` rows per key; the rank filter is applied before and after the shuffle."""
    return df.withColumn("rk", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rk") <= limit)
