"""Operators on aligned rows ``(msa_id, member, role, a)``.

Site-level facts are aggregated by ``(msa_id, site, residue)``; those keys
spread a huge alignment over all tasks, and pair sums are taken from the
counts in closed form, never by pairing the members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from strandframe.functions import divergence as D, runs as U
from strandframe.operators import alignment_sets as S


def cells_of(rows: DataFrame) -> DataFrame:
    """One row ``(..., site, r)`` per character of ``a``, sites from 1."""
    kept = [c for c in rows.columns if c != "a"]
    return rows.select(*kept, F.posexplode(F.split("a", "")).alias("p", "r")).filter("r != ''").select(*kept, (F.col("p") + 1).cast("long").alias("site"), "r")


def profile(cells: DataFrame) -> DataFrame:
    """Residue counts per site: ``(msa_id, site, r, n)``, gaps left out."""
    return cells.filter("r != '-'").groupBy("msa_id", "site", "r").agg(F.count("*").alias("n"))


def depth(rows: DataFrame) -> DataFrame:
    return rows.groupBy("msa_id").agg(F.count("*").alias("many"), F.max(F.length("a")).cast("long").alias("width"))


def site_counts(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Per site: residues, equal pairs, members; one row per site with any residue."""
    per = profile(cells).groupBy("msa_id", "site").agg(
        F.sum("n").alias("res"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("eq"), F.max("n").alias("top"),
        F.count("*").alias("kinds"),
    )
    return per.join(depth(rows), "msa_id")


def pair_score(match: int, mismatch: int, gap: int):
    """Sum-of-pairs score of one site from its counts."""
    res, many, eq = F.col("res"), F.col("many"), F.col("eq")
    pairs = (res * (res - 1) / 2).cast("long")
    return eq * match + (pairs - eq) * mismatch + res * (many - res) * gap


def sum_of_pairs(cells: DataFrame, rows: DataFrame, match=2, mismatch=-1, gap=-2) -> DataFrame:
    return site_counts(cells, rows).groupBy("msa_id").agg(F.sum(pair_score(match, mismatch, gap)).alias("sp"))


def consensus(cells: DataFrame, rows: DataFrame, empty: str = "X") -> DataFrame:
    """Most frequent residue per site (ties: first letter) joined in site order; ``empty`` where all members have gaps.

    Letter k is site k.  The string has one letter per site, so its size is bounded by the row width.
    """
    best = profile(cells).groupBy("msa_id", "site").agg(F.max_by("r", F.struct("n", -F.ascii("r"))).alias("r"))
    sites = depth(rows).filter("width > 0").select("msa_id", F.explode(F.sequence(F.lit(1).cast("long"), "width")).alias("site"))
    full = sites.join(best, ["msa_id", "site"], "left").withColumn("r", F.coalesce("r", F.lit(empty)))
    ordered = F.array_sort(F.collect_list(F.struct("site", "r")))
    return full.groupBy("msa_id").agg(F.array_join(ordered["r"], "").alias("consensus"))


def kept_sites(cells: DataFrame, rows: DataFrame, max_gap: float) -> DataFrame:
    """Sites whose gap fraction stays under ``max_gap``, renumbered from 1."""
    per = cells.filter("r != '-'").groupBy("msa_id", "site").agg(F.count("*").alias("res")).join(depth(rows), "msa_id")
    kept = per.filter((F.col("many") - F.col("res")) < F.lit(max_gap) * F.col("many"))
    order = W.partitionBy("msa_id").orderBy("site")  # sites of one alignment: bounded by the row width
    return kept.select("msa_id", "site", F.row_number().over(order).cast("long").alias("new_site"))


def consecutive_pairs(rows: DataFrame) -> DataFrame:
    """Members 2k and 2k+1 side by side: equi-join on ``(msa_id, member div 2)``."""
    key = F.floor(F.col("member") / 2).alias("pair")
    left = rows.filter("member % 2 = 0").select("msa_id", key, F.col("member").alias("i"), F.col("a").alias("a1"))
    right = rows.filter("member % 2 = 1").select("msa_id", key, F.col("member").alias("j"), F.col("a").alias("a2"))
    return left.join(right, ["msa_id", "pair"])


def first_versus_others(rows: DataFrame, span: int = 1024) -> DataFrame:
    """First member against every other; the first row is copied once per ``span`` members, so a huge alignment splits with its depth."""
    head = rows.groupBy("msa_id").agg(F.max(F.when(F.col("member") == 0, F.col("a"))).alias("a1"), F.max("member").alias("top")).filter("a1 IS NOT NULL")
    firsts = head.select("msa_id", "a1", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / span))).alias("part"))
    others = rows.filter("member > 0").select("msa_id", F.col("member").alias("j"), F.col("a").alias("a2"), F.floor(F.col("member") / span).alias("part"))
    return others.join(firsts, ["msa_id", "part"]).drop("part")


def others_versus_last(rows: DataFrame, span: int = 1024) -> DataFrame:
    """Every other member against the last one, split in the same way."""
    last = rows.groupBy("msa_id").agg(F.max_by(F.struct("member", "a"), "member").alias("z")).select(
        "msa_id", F.col("z.member").alias("j"), F.col("z.a").alias("a2"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("z.member") / span))).alias("part"),
    )
    others = rows.select("msa_id", F.col("member").alias("i"), F.col("a").alias("a1"), F.floor(F.col("member") / span).alias("part"))
    return others.join(last, ["msa_id", "part"]).filter("i < j").drop("part")


def pair_statistics(pairs: DataFrame, *keys: str) -> DataFrame:
    d = pairs.select(*keys, D.pair_counts("a1", "a2").alias("s")).select(*keys, "s.*")
    c = [F.col(x) for x in ("mch", "mmc", "unp", "gap")]
    return d.withColumn("dist", D.gap_scaled_divergence(*c)).withColumn("dod", D.degree_of_divergence(*c))


def gap_runs(rows: DataFrame) -> DataFrame:
    """Internal and leading gap runs of each row: ``(msa_id, member, gps, gln)``, gps 0-based."""
    d = rows.select("msa_id", "member", F.inline(U.runs("a", U.GAP)))
    return d.select("msa_id", "member", F.col("l").alias("gps"), (F.col("r") - F.col("l")).alias("gln"))


def gap_states(rows: DataFrame) -> DataFrame:
    """Members per site and current gap length: ``(msa_id, site, gaplen, n)``."""
    d = gap_runs(rows).select("msa_id", "gps", F.explode(F.sequence(F.lit(1), "gln")).alias("gaplen"))
    return d.groupBy("msa_id", (F.col("gps") + F.col("gaplen")).cast("long").alias("site"), F.col("gaplen").cast("long").alias("gaplen")).agg(
        F.count("*").alias("n")
    )


def gap_openings(rows: DataFrame, first) -> DataFrame:
    """Gap openings between two groups of members, ``(msa_id, openings)``: ``first`` says who belongs to the first.

    At a site a gap of one member against a residue of another opens if the gap
    has lasted no longer than the run of gaps that ends right before the residue.
    Counted from both groups' frequencies of states per site (sum of products over
    states of greater or equal length); members are never paired.
    """
    side = rows.select("msa_id", first.cast("int").alias("side"), "a")
    runs = side.select("msa_id", "side", F.length("a").alias("width"), F.inline(U.runs("a", U.GAP)))
    lasted = runs.select("msa_id", "side", "l", F.explode(F.sequence(F.lit(1), F.col("r") - F.col("l"))).alias("k"))
    gaps = lasted.groupBy("msa_id", "side", (F.col("l") + F.col("k")).alias("site"), (F.col("k") - 1).alias("before")).agg(F.count("*").alias("n"))
    after = runs.filter("r < width").groupBy("msa_id", "side", (F.col("r") + 1).alias("site"), (F.col("r") - F.col("l")).alias("run")).agg(F.count("*").alias("m"))
    letters = side.select("msa_id", "side", F.posexplode(F.split("a", "")).alias("p", "c")).filter("c NOT IN ('-', '')")
    total = letters.groupBy("msa_id", "side", (F.col("p") + 1).alias("site")).agg(F.count("*").alias("m"))
    at = ["msa_id", "side", "site"]
    fresh = total.join(after.groupBy(*at).agg(F.sum("m").alias("late")), at, "left")  # residues without a run of gaps before them
    residues = after.select(*at, "run", "m").unionByName(fresh.select(*at, F.lit(0).alias("run"), (F.col("m") - F.coalesce("late", F.lit(0))).alias("m")))
    met = gaps.join(residues.withColumn("side", 1 - F.col("side")), at).filter("run >= before")
    return met.groupBy("msa_id").agg(F.sum(F.col("n") * F.col("m")).alias("openings"))


def reverse_translation(rows: DataFrame, usage: DataFrame, alone: int = S.ALONE) -> DataFrame:
    """Base frequencies ``(msa_id, site, pos, base, freq)`` at the three codon positions of every column of amino acids.

    ``usage``: ``(aa, codon, share)`` with shares that add up to one per amino acid, a row for each codon.
    """
    shares = [tuple(r) for r in usage.select("aa", "codon", "share").collect()]
    places = sorted({(p, c) for _, codon, _ in shares for p, c in enumerate(codon, 1)})
    letter = {aa: k for k, aa in enumerate(sorted({r[0] for r in shares}))}
    weight = np.zeros((len(letter), len(places)))
    for aa, codon, share in shares:
        for p, c in enumerate(codon, 1):
            weight[letter[aa], places.index((p, c))] += share
    known = {ord(aa): k for aa, k in letter.items()}
    pos, base = pa.array([p for p, _ in places], pa.int64()), pa.array([c for _, c in places], pa.string())

    def kernel(t: pa.Table) -> pa.Table:
        x = S.letters(t)
        at, _, n = x.same()
        own = np.array([known.get(c, -1) for c in x.code[at].tolist()], np.int64)
        column, own, n = x.column[at][own >= 0], own[own >= 0], n[own >= 0]
        columns, which = np.unique(column, return_inverse=True)
        w = np.zeros((len(columns), len(places)))
        for k in range(len(letter)):  # a letter is once in a column at most
            w[which[own == k]] += n[own == k, None] * weight[k]
        i, j = np.nonzero(w)
        of = np.searchsorted(x.first, columns, "right") - 1  # of alignments without columns the last one starts there
        many = np.bincount(x.of, minlength=len(x.sets))
        site = (columns - x.first[of] + 1)[i]
        return pa.table({"msa_id": x.sets.take(pa.array(of[i])), "site": site, "pos": pos.take(pa.array(j)), "base": base.take(pa.array(j)), "freq": w[i, j] / many[of[i]]})

    def larger(huge: DataFrame) -> DataFrame:
        per = profile(cells_of(huge)).join(F.broadcast(usage), F.col("r") == F.col("aa"))
        bases = per.select("msa_id", "site", (F.col("n") * F.col("share")).alias("w"), F.posexplode(F.split("codon", "")).alias("pos", "base")).filter("base <> ''")
        g = bases.groupBy("msa_id", "site", "pos", "base").agg(F.sum("w").alias("w"))
        return g.join(depth(huge).hint("merge"), "msa_id").select("msa_id", "site", (F.col("pos") + 1).cast("long").alias("pos"), "base", (F.col("w") / F.col("many")).alias("freq"))

    return S.by_alignment(rows.select("msa_id", "a"), kernel, "msa_id long, site long, pos long, base string, freq double", larger, alone)


#: Characters of pairs that a kernel maps at once; a longer pair alone.
PAIR_CELLS = 1_000_000


def _residues(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which characters of all texts are residues, how many there are up to each of its text, and the texts' offsets."""
    offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    letter = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32) != ord("-")
    total = np.concatenate([[0], np.cumsum(letter)])
    return letter, total[1:] - np.repeat(total[offs[:-1]], np.diff(offs)), offs


def _facing(first: list[str], second: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, num_i, num_j)`` of the residues that face each other, numbered from 1 in their texts."""
    (x, num_i, a), (y, num_j, b) = _residues(first), _residues(second)
    size = np.minimum(np.diff(a), np.diff(b))
    row = np.repeat(np.arange(len(size)), size)
    p = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a[row] + p, b[row] + p
    both = x[i] & y[j]
    return row[both], num_i[i[both]], num_j[j[both]]


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Slices of batches ``(msa_id, i, j, text, ...)`` of about ``PAIR_CELLS`` characters, with their texts; pairs with a null text are left out."""
    for batch in batches:
        whole = pa.Table.from_batches([batch]).drop_null().combine_chunks()
        for batch in whole.to_batches():
            size = np.cumsum(sum(pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[3:]))
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + PAIR_CELLS, "right")))
                part = batch.slice(low, high - low)
                yield part, [c.to_pylist() for c in part.columns[3:]]
                low = high


def _keyed(part: pa.RecordBatch, row: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = [c.take(pa.array(row)) for c in part.columns[:3]]
    out = pa.RecordBatch.from_arrays([*keys, *(pa.array(v.astype(np.int64)) for v in values.values())], ["msa_id", "i", "j", *values])
    yield from (out.slice(k, 1 << 16) for k in range(0, out.num_rows, 1 << 16))


def residue_maps(pairs: DataFrame) -> DataFrame:
    """Residues of members ``(msa_id, i, j, a1, a2)`` that face each other, numbered from 1: ``(msa_id, i, j, num_i, num_j)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (a1, a2) in _pair_batches(batches):
            row, num_i, num_j = _facing(a1, a2)
            yield from _keyed(part, row, num_i=num_i, num_j=num_j)

    return pairs.select(*[F.col(c).cast("long") for c in ("msa_id", "i", "j")], "a1", "a2").mapInArrow(run, "msa_id long, i long, j long, num_i long, num_j long")


def shared_segments(pairs: DataFrame) -> DataFrame:
    """Stretches that two alignments of the same two sequences share: ``(msa_id, i, j, start_i, start_j, len)``.

    ``a1`` and ``a2`` are the rows of one, ``b1`` and ``b2`` those of the other;
    common pairs of residues that follow each other on both sides make a segment.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (a1, a2, b1, b2) in _pair_batches(batches):
            one, other = _facing(a1, a2), _facing(b1, b2)
            base = 1 + max((int(x.max()) for x in (*one[1:], *other[1:]) if len(x)), default=0)
            same = np.intersect1d(*((row * base + i) * base + j for row, i, j in (one, other)), assume_unique=True)
            row, i, j = same // base // base, same // base % base, same % base
            new = np.ones(len(same), bool)
            new[1:] = np.diff(same) != base + 1  # a step of both
            at = np.flatnonzero(new)
            yield from _keyed(part, row[at], start_i=i[at], start_j=j[at], len=np.diff(np.append(at, len(same))))

    return pairs.select(*[F.col(c).cast("long") for c in ("msa_id", "i", "j")], "a1", "a2", "b1", "b2").mapInArrow(run, "msa_id long, i long, j long, start_i long, start_j long, len long")


def member_distance_sums(rows: DataFrame, alone: int = S.ALONE) -> DataFrame:
    """Sum over the other members of mismatching shared sites, from the profile: ``(msa_id, member, mismatches, shared)``."""

    def kernel(t: pa.Table) -> pa.Table:
        x = S.letters(t)
        _, which, n = x.same()
        res = np.bincount(x.column)[x.column] if len(x.row) else x.row
        sums = [np.bincount(x.row, v, t.num_rows).astype(np.int64) for v in (res - n[which], res - 1)]
        some = pa.array(np.bincount(x.row, minlength=t.num_rows) > 0)
        d = pa.table({"msa_id": t["msa_id"], "member": t["member"], "mismatches": sums[0], "shared": sums[1]}).filter(some)
        g = d.group_by(["msa_id", "member"]).aggregate([("mismatches", "sum"), ("shared", "sum")])
        return pa.table({"msa_id": g["msa_id"], "member": g["member"], "mismatches": g["mismatches_sum"], "shared": g["shared_sum"]})

    def larger(huge: DataFrame) -> DataFrame:
        # both sides are cells, of which the optimizer sees no more than the bytes of the texts
        own = cells_of(huge).filter("r != '-'").select("msa_id", "member", "site", "r")
        prof = profile(own)
        total = prof.groupBy("msa_id", "site").agg(F.sum("n").alias("res"))
        at = prof.hint("merge").join(total.hint("merge"), ["msa_id", "site"])
        return own.hint("merge").join(at.hint("merge"), ["msa_id", "site", "r"]).groupBy("msa_id", "member").agg(
            F.sum(F.col("res") - F.col("n")).alias("mismatches"), F.sum(F.col("res") - 1).alias("shared")
        )

    return S.by_alignment(rows.select("msa_id", "member", "a"), kernel, "msa_id long, member long, mismatches long, shared long", larger, alone)


def weighted_identity(rows: DataFrame, alone: int = S.ALONE) -> DataFrame:
    """Products of the weights ``w`` of all pairs of members with the same letter in a column, summed: ``(msa_id, weighted_identity)``."""

    def kernel(t: pa.Table) -> pa.Table:
        x = S.letters(t)
        at, which, _ = x.same()
        w = t["w"].to_numpy()[x.row]
        once, twice = np.bincount(which, w, len(at)), np.bincount(which, w * w, len(at))
        of = x.of[x.row[at]]
        total = np.bincount(of, (once * once - twice) / 2, len(x.sets)).astype(np.int64)
        return pa.table({"msa_id": x.sets, "weighted_identity": total}).filter(pa.array(np.bincount(of, minlength=len(x.sets)) > 0))

    def larger(huge: DataFrame) -> DataFrame:
        d = huge.select("msa_id", "w", F.posexplode(F.split("a", "")).alias("site", "r")).filter("r NOT IN ('-', '')")
        g = d.groupBy("msa_id", "site", "r").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
        return g.groupBy("msa_id").agg(F.sum(((F.col("w") * F.col("w") - F.col("w2")) / 2).cast("long")).alias("weighted_identity"))

    return S.by_alignment(rows.select("msa_id", "w", "a"), kernel, "msa_id long, weighted_identity long", larger, alone)


def apportion(rows: DataFrame, slots: int, alone: int = S.ALONE) -> DataFrame:
    """Reduce every column to ``slots`` pseudo members by largest remainder: ``(msa_id, site, column)``."""

    def kernel(t: pa.Table) -> pa.Table:
        x = S.letters(t)
        at, _, n = x.same()
        column, code = x.column[at], x.code[at]
        columns, start, which = np.unique(column, return_index=True, return_inverse=True)
        of = np.searchsorted(x.first, columns, "right") - 1  # of alignments without columns the last one starts there
        many = np.bincount(x.of, minlength=len(x.sets))[of]
        gaps = many - np.bincount(which, n, len(columns)).astype(np.int64)
        some = np.flatnonzero(gaps)
        which, code, n = (np.concatenate(z) for z in ((which, some), (code, np.full(len(some), ord("-"))), (n, gaps[some])))
        share = n * slots
        base, rem = share // many[which], share % many[which]
        left = slots - np.bincount(which, base, len(columns)).astype(np.int64)
        order = np.lexsort((code, -rem, which))
        first = np.searchsorted(which[order], np.arange(len(columns)))
        num = base[order] + (np.arange(len(order)) - first[which[order]] < left[which[order]])
        order = np.lexsort((code[order], which[order])), order
        num, code = num[order[0]], code[order[1]][order[0]]
        kinds, kind = np.unique(np.repeat(code, num), return_inverse=True)
        letters = pa.array([chr(c) for c in kinds], pa.string()).take(pa.array(kind))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(columns) + 1) * slots, pa.int32()), letters)
        return pa.table({"msa_id": x.sets.take(pa.array(of)), "site": columns - x.first[of] + 1, "column": pc.binary_join(lists, "")})

    def larger(huge: DataFrame) -> DataFrame:
        return apportion_cells(cells_of(huge), huge, slots)

    return S.by_alignment(rows.select("msa_id", "a"), kernel, "msa_id long, site long, column string", larger, alone)


def apportion_cells(cells: DataFrame, rows: DataFrame, slots: int) -> DataFrame:
    """``apportion`` cell by cell."""
    prof = profile(cells).join(depth(rows), "msa_id").select("msa_id", "site", "r", "n", "many")
    res = prof.groupBy("msa_id", "site", "many").agg(F.sum("n").alias("res"))
    gaps = res.filter("many > res").select("msa_id", "site", F.lit("-").alias("r"), (F.col("many") - F.col("res")).alias("n"), "many")
    allr = prof.unionByName(gaps)
    share = F.col("n") * slots
    d = allr.select("msa_id", "site", "r", F.floor(share / F.col("many")).alias("base"), (share % F.col("many")).alias("rem"))
    site = W.partitionBy("msa_id", "site")  # at most one row per letter
    d = d.withColumn("left", F.lit(slots) - F.sum("base").over(site)).withColumn(
        "rank", F.row_number().over(site.orderBy(F.desc("rem"), "r"))
    )
    d = d.withColumn("num", (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("int"))
    letters = F.transform(F.array_sort(F.collect_list(F.struct(F.col("r"), F.col("num")))), lambda x: F.repeat(x["r"], x["num"]))
    return d.filter("num > 0").groupBy("msa_id", "site").agg(F.array_join(letters, "").alias("column"))


def scoring_segments(scores: DataFrame, thr: int) -> DataFrame:
    """Maximal scoring segments per alignment from ``(msa_id, site, score)``.

    A segment opens at a positive site when the running score is zero, ends at
    the best score over ``thr`` and is closed once the score returns to zero or
    falls ``thr`` under that best.  The site scores of one alignment are one
    array, bounded by the row width whatever the number of members.
    """
    ordered = F.array_sort(F.collect_list(F.struct("site", "score")))
    empty = F.array().cast("array<struct<l:bigint,r:bigint,score:bigint>>")
    zero = F.lit(0).cast("long")
    start = F.struct(
        zero.alias("s"), zero.alias("mx"), zero.alias("l"), zero.alias("r"), empty.alias("out")
    )

    def seg(l, r, mx):
        return F.array(F.struct(l.alias("l"), r.alias("r"), mx.alias("score")))

    def step(a, x):
        raw = a["s"] + x["score"]
        l = F.when((a["s"] == 0) & (x["score"] > 0), x["site"]).otherwise(a["l"])
        s = F.greatest(raw, zero)
        better = (raw >= thr) & (raw > a["mx"])
        mx = F.when(better, raw).otherwise(a["mx"])
        r = F.when(better, x["site"]).otherwise(a["r"])
        close = (mx > 0) & ((s <= 0) | (s < mx - thr))
        return F.struct(
            F.when(close, zero).otherwise(s).alias("s"), F.when(close, zero).otherwise(mx).alias("mx"), l.alias("l"), r.alias("r"),
            F.when(close, F.concat(a["out"], seg(l, r, mx))).otherwise(a["out"]).alias("out"),
        )

    def finish(a):
        return F.when(a["mx"] > 0, F.concat(a["out"], seg(a["l"], a["r"], a["mx"]))).otherwise(a["out"])

    per = scores.groupBy("msa_id").agg(ordered.alias("sites"))
    return per.select("msa_id", F.inline(F.aggregate("sites", start, step, finish)))
