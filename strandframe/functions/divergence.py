"""Distances and corrections from pair statistics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandframe.functions.residues import col

OUT_OF_RANGE = 1024.0
# Parameters of the word-match distance curves, keyed by (alphabet, word length).
WORD_CURVE = {(14, 3): (0.92042, 0.18677), (14, 4): (0.34576, 0.07108), (14, 5): (0.22333, 0.03164), (20, 4): (0.18704, 0.00501)}


def pair_counts(a, b) -> Column:
    """struct(mch, mmc, unp, gap) of two aligned rows of equal coordinates.

    ``gap`` counts openings: a gap opens when the run on its own side is not
    longer than the run on the other side.  The shorter row is padded with gaps.
    """
    pairs = F.zip_with(F.split(col(a), ""), F.split(col(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    zero = F.lit(0)
    start = F.struct(*[zero.alias(n) for n in ("mch", "mmc", "unp", "gap", "ga", "gb")])

    def step(s: Column, p: Column) -> Column:
        ga = F.coalesce(p["x"], F.lit("-")) == "-"
        gb = F.coalesce(p["y"], F.lit("-")) == "-"
        one = ga != gb
        opens = (ga & ~gb & (s["ga"] <= s["gb"])) | (gb & ~ga & (s["gb"] <= s["ga"]))
        both = ~ga & ~gb
        same = p["x"] == p["y"]
        return F.struct(
            (s["mch"] + F.when(both & same, 1).otherwise(0)).alias("mch"),
            (s["mmc"] + F.when(both & ~same, 1).otherwise(0)).alias("mmc"),
            (s["unp"] + F.when(one, 1).otherwise(0)).alias("unp"),
            (s["gap"] + F.when(opens, 1).otherwise(0)).alias("gap"),
            F.when(ga, s["ga"] + 1).otherwise(0).alias("ga"),
            F.when(~gb, 0).when(ga, s["gb"]).otherwise(s["gb"] + 1).alias("gb"),
        )

    return F.aggregate(
        pairs, start, step, lambda s: F.struct(*[s[n].cast("long").alias(n) for n in ("mch", "mmc", "unp", "gap")])
    )


def gap_scaled_divergence(mch, mmc, unp, gap, frac: float = 0.8) -> Column:
    denominator = F.lit(frac) * gap + F.lit(1 - frac) * unp + mch + mmc
    return F.when(denominator > 0, 1.0 - mch / denominator).otherwise(F.lit(0.0))


def degree_of_divergence(mch, mmc, unp, gap, v: float = 0.5, u: float = 0.5) -> Column:
    fd = mmc + F.lit(v) * gap + F.lit(u) * unp
    return F.when(fd + mch > 0, fd / (fd + mch)).otherwise(F.lit(0.0))


def jukes_cantor(p: Column, states: int = 4) -> Column:
    """-(k-1)/k ln(1 - k/(k-1) p); 0 for p <= 0 and a sentinel past saturation."""
    b = (states - 1) / states
    y = 1.0 - p / F.lit(b)
    return F.when(p <= 0, F.lit(0.0)).when(y <= 0, F.lit(OUT_OF_RANGE)).otherwise(F.lit(-b) * F.log(y))


# Coefficients of the two pieces of the protein curve.
def _pam_polynomial(x: Column) -> Column:
    return F.when(x <= 0.7, 1.0 - (0.987151 + 0.220560 * x) * x).otherwise(
        -1.260444 + (8.603930 - (13.869219 - 6.521836 * x) * x) * x
    )


def pam_correct(x: Column, mode: int = 2, nucleotide: bool = False) -> Column:
    """Multiple-hit correction of a divergence, in PAM units (x100): 0 none, 1 logarithm, 2 polynomial (protein only)."""
    if mode == 0:
        return F.when(x <= 0, F.lit(0.0)).otherwise(100.0 * x)
    mode = 1 if nucleotide else mode
    alpha = 0.75 if nucleotide else 0.95 if mode == 1 else 1.0
    y = 1.0 - x / F.lit(alpha) if mode == 1 else _pam_polynomial(x)
    return F.when(x <= 0, F.lit(0.0)).when(y > 0, F.lit(-100.0 * alpha) * F.log(y)).otherwise(F.lit(OUT_OF_RANGE))


def pam_step(x: Column, step: int = 10, top: int = 300) -> Column:
    """Divergence to the nearest PAM level, a multiple of ``step`` up to ``top``."""
    y = _pam_polynomial(x)
    raw = F.floor(F.lit(-100.0) * F.log(y)) + step // 2
    level = F.floor((raw + step - 1) / step) * step
    return F.when((x >= 1.0) | (y <= 0), F.lit(top)).otherwise(F.least(level, F.lit(top))).cast("long")


def word_distance(f: Column, alphabet: int = 20, k: int = 5) -> Column:
    """Word-match fraction to a divergence by the logarithmic curve."""
    a, b = WORD_CURVE.get((alphabet, k), WORD_CURVE[20, 4])
    return F.lit(-a) * F.log((b + f) / (b + 1.0))
