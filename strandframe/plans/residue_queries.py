"""Scalar sequence functions, composition, words, ORFs and patterns over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import codons as C, residues as R
from strandframe.operators import composition as K, orf as O
from strandframe.plans.fragments import NT, QSEQ, SEQ, chars, words
from strandframe.plans.registry import query

CODE_ROWS = ", ".join(
    f"('{a}{b}{c}', '{C.STANDARD[16 * i + 4 * j + k]}', '{C.tron_string()[16 * i + 4 * j + k]}', {16 * i + 4 * j + k})"
    for i, a in enumerate(C.BASES) for j, b in enumerate(C.BASES) for k, c in enumerate(C.BASES)
)
CODE = f"gcode(codon, aa, tron, num) AS (VALUES {CODE_ROWS})"


@query("A1 P1 F16", f"WITH {SEQ}, {chars('seq')} SELECT seq_id, r AS residue, count(*) AS n FROM chars GROUP BY ALL")
def residue_composition(t):
    return K.composition(t.seqs, "seq_id")


@query("A8", f"""WITH {SEQ}, {chars('seq', 'source')}
SELECT source, r AS residue, count(*) AS n FROM chars GROUP BY GROUPING SETS ((source, r), (r))""")
def composition_each_and_total(t):
    per = K.composition(t.seqs, "source")
    return per.groupingSets([["source", "residue"], ["residue"]], "source", "residue").agg(F.sum("n").alias("n"))


@query("S24", f"""WITH {NT}, c AS (
SELECT seq.seq_id, length(seq.s) AS total, length(seq.s) - length(translate(seq.s, 'ACGTU', '')) AS nuc,
  length(translate(seq.s, 'NX', '')) AS plain, length(seq.s) - length(translate(seq.s, 'JU', '')) AS marks,
  length(seq.s) - length(translate(seq.s, 'O', '')) AS o, length(seq.s) - length(translate(seq.s, 'T', '')) AS nt_,
  length(seq.s) - length(translate(seq.s, 'U', '')) AS nu, length(translate(seq.s, 'N', '')) AS non_n
FROM seq)
SELECT seq_id, CASE WHEN non_n = 0 THEN 'DNA'
  WHEN nuc * 100 > plain * 75 THEN CASE WHEN nt_ >= nu THEN 'DNA' ELSE 'RNA' END
  WHEN marks > 0 AND (marks + o) * 100 > total * 5 THEN 'TRON' ELSE 'PROTEIN' END AS molc,
  'DNA' AS molc_projected FROM c""")
def molecule_inference(t):
    return t.seqs.select(
        "seq_id", R.molecule_type("s").alias("molc"), R.molecule_type(R.nucleotide("s")).alias("molc_projected")
    )


@query("P2 P1", f"""WITH {NT} SELECT seq_id, reverse(translate(s, 'ACGT', 'TGCA')) AS rc,
  translate(s, 'ACGT', 'TGCA') AS comp FROM nt""")
def reverse_complement(t):
    return t.nts.select("seq_id", R.reverse_complement("s").alias("rc"), R.complement("s").alias("comp"))


@query("P10 P11", f"""WITH {NT}, {CODE}, {words('nt', 3)}
SELECT seq_id, string_agg(tron, '' ORDER BY pos) AS tron FROM words JOIN gcode ON w = codon GROUP BY seq_id""")
def tron_codes(t):
    return t.nts.filter(F.length("s") >= 3).select("seq_id", C.tron("s").alias("tron"))


@query("P12 P14", f"""WITH {NT}, {CODE}, {words('nt', 3)}
SELECT seq_id, CAST((pos - 1) % 3 AS INTEGER) AS frame, string_agg(aa, '' ORDER BY pos) AS protein
FROM words JOIN gcode ON w = codon GROUP BY ALL""")
def translate_frames(t):
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), C.translate("s", 1, f).alias("protein")) for f in range(3)])
    return t.nts.select("seq_id", F.inline(frames)).filter("protein != ''")


@query("P14 P11", f"""WITH {NT}, {CODE}, {words('nt', 3)}
SELECT seq_id, count(*) FILTER (aa = '*') AS stops_standard,
  count(*) FILTER (w IN ('TAA', 'TAG')) AS stops_code4, count(*) FILTER (w IN ('TAA', 'TAG', 'AGA', 'AGG')) AS stops_code2
FROM words JOIN gcode ON w = codon WHERE (pos - 1) % 3 = 0 GROUP BY seq_id""")
def genetic_code_choice(t):
    def stops(code):
        return R.count_in(C.translate("s", code), "*").cast("long")

    return t.nts.filter(F.length("s") >= 3).select(
        "seq_id", stops(1).alias("stops_standard"), stops(4).alias("stops_code4"), stops(2).alias("stops_code2")
    )


@query("A6 F20", f"""WITH {NT}, {CODE}, {words('nt', 3, 'lang')}
SELECT lang, codon, CAST(num AS BIGINT) AS num, aa, count(*) AS n FROM words JOIN gcode ON w = codon
WHERE (pos - 1) % 3 = 0 GROUP BY ALL""")
def codon_usage(t):
    aa = F.array(*[F.lit(x) for x in C.STANDARD])
    return (
        t.nts.select("lang", F.explode(R.blocks("s", 3)).alias("codon")).groupBy("lang", "codon").agg(F.count("*").alias("n"))
        .withColumn("num", C.codon_number(F.col("codon")).cast("long"))
        .select("lang", C.codon_text(F.col("num")).alias("codon"), "num", F.element_at(aa, (F.col("num") + 1).cast("int")).alias("aa"), "n")
    )


@query("A7", f"""WITH {NT}, {words('nt', 6, 'lang')}
SELECT lang, substr(w, 1, 3) AS codon1, substr(w, 4, 3) AS codon2, count(*) AS n FROM words
WHERE (pos - 1) % 3 = 0 GROUP BY ALL""")
def dicodon_counts(t):
    codons = t.nts.select("lang", R.blocks("s", 3).alias("c"))
    return (
        codons.select("lang", F.inline(F.arrays_zip("c", F.slice("c", F.lit(2), F.size("c")))).alias("codon1", "codon2"))
        .filter("codon2 IS NOT NULL").groupBy("lang", "codon1", "codon2").agg(F.count("*").alias("n"))
    )


@query("A4", f"""WITH {NT}, {chars('nt')}, g AS (SELECT seq_id, count(*) AS total,
  count(*) FILTER (r IN ('C','G') AND (pos-1)%3=0) AS g1, count(*) FILTER ((pos-1)%3=0) AS n1,
  count(*) FILTER (r IN ('C','G') AND (pos-1)%3=1) AS g2, count(*) FILTER ((pos-1)%3=1) AS n2,
  count(*) FILTER (r IN ('C','G') AND (pos-1)%3=2) AS g3, count(*) FILTER ((pos-1)%3=2) AS n3,
  count(*) FILTER (r IN ('A','G')) AS ag FROM chars GROUP BY seq_id)
SELECT seq_id, CASE WHEN n1>0 THEN 100.0::DOUBLE*g1/n1 END AS gc1, CASE WHEN n2>0 THEN 100.0::DOUBLE*g2/n2 END AS gc2,
 CASE WHEN n3>0 THEN 100.0::DOUBLE*g3/n3 END AS gc3, 100.0::DOUBLE*(g1+g2+g3)/total AS gc, 100.0::DOUBLE*ag/total AS purine FROM g""")
def gc_by_phase(t):
    return K.phase_composition(t.nts)


# RNA/DNA hybrid nearest-neighbour enthalpy and entropy (Sugimoto et al. 1995)
# in tenths, first base A C G T by second base A C G T.
STACK_H = [-78, -59, -91, -83, -90, -93, -163, -70, -55, -80, -128, -78, -78, -86, -104, -115]
STACK_S = [-219, -123, -235, -239, -261, -232, -471, -197, -135, -171, -319, -216, -232, -229, -284, -364]
STACK_ROWS = ", ".join(f"('{a}{b}', {STACK_H[4 * i + j]}, {STACK_S[4 * i + j]})" for i, a in enumerate("ACGT") for j, b in enumerate("ACGT"))


@query("A5", f"""WITH {NT}, stack(w, h, e) AS (VALUES {STACK_ROWS}), {words('nt', 2)},
g AS (SELECT seq_id, count(*) AS stacks, sum(h) AS h, sum(e) AS e FROM words JOIN stack USING (w) GROUP BY seq_id)
SELECT seq_id, stacks, (19 + h) / 10.0::DOUBLE AS dh, (-39 + e) / 10.0::DOUBLE AS ds,
 ((19 + h) * 100000 - 31015 * (-39 + e)) / 1000000.0::DOUBLE AS dg37 FROM g""")
def duplex_thermodynamics(t):
    n1 = F.instr(F.lit("ACGT"), F.substring("word", 1, 1)) - 1
    n2 = F.instr(F.lit("ACGT"), F.substring("word", 2, 1)) - 1
    at = (n1 * 4 + n2 + 1).cast("int")
    h, e = (F.element_at(F.array(*[F.lit(x) for x in v]), at) for v in (STACK_H, STACK_S))
    per = K.word_counts(t.nts, 2, "seq_id").groupBy("seq_id").agg(
        F.sum("n").alias("stacks"), F.sum(h * F.col("n")).alias("h"), F.sum(e * F.col("n")).alias("e")
    )
    h, e = F.col("h") + 19, F.col("e") - 39
    return per.select(
        "seq_id", "stacks", (h / 10.0).alias("dh"), (e / 10.0).alias("ds"),
        ((h * 100000 - e * 31015) / 1000000.0).alias("dg37"),
    )


@query("A5", f"WITH {NT}, {words('nt', 2, 'lang')} SELECT lang, w AS word, count(*) AS n FROM words GROUP BY ALL")
def dinucleotide_counts(t):
    return K.word_counts(t.nts, 2, "lang")


AA_ROWS = ", ".join(f"('{a}', {round(w * 100)})" for a, w in zip(R.AMINO, R.AMINO_WEIGHT))


@query("A9", f"""WITH {SEQ}, {chars('seq')}, wt(r, w) AS (VALUES {AA_ROWS}),
g AS (SELECT seq_id, count(*) AS n, sum(coalesce(w, 0)) AS w FROM chars LEFT JOIN wt USING (r) GROUP BY seq_id)
SELECT seq_id, n, (w * 10 - 18015 * (n - 1)) / 1000.0::DOUBLE AS mw FROM g""")
def protein_molecular_weight(t):
    weights = F.create_map(*[F.lit(x) for a, w in zip(R.AMINO, R.AMINO_WEIGHT) for x in (a, round(w * 100))])
    per = K.composition(t.seqs, "seq_id").groupBy("seq_id").agg(
        F.sum("n").alias("n"), F.sum(F.coalesce(weights[F.col("residue")], F.lit(0)) * F.col("n")).alias("w")
    )
    return per.select("seq_id", "n", ((F.col("w") * 10 - round(R.WATER * 1000) * (F.col("n") - 1)) / 1000.0).alias("mw"))


@query("P27 P1", f"""WITH {SEQ}, z AS (SELECT seq_id, source, translate(s, 'MFILVACWYQHPGTSNRKDE', 'MMMMMACWWWWWGGGGRRDD') AS s FROM seq),
{chars('z', 'source')} SELECT source, r AS residue, count(*) AS n FROM chars GROUP BY ALL""")
def reduced_alphabet_composition(t):
    return K.composition(t.seqs.select("source", R.reduce_alphabet("s").alias("s")), "source")


@query("K5", f"""WITH {SEQ}, {chars('seq')}
SELECT seq_id, CAST(sum(((pos - 1) % 57 + 1) * ascii(r)) % 10000 AS BIGINT) AS checksum FROM chars GROUP BY seq_id""")
def gcg_checksums(t):
    return t.seqs.filter("s != ''").select("seq_id", R.gcg_checksum("s").alias("checksum"))


@query("P8 P9", f"""WITH {SEQ} SELECT seq_id, translate(s, 'BJOUXZ', '') AS kept,
CAST(length(s) - length(translate(s, 'BJOUXZ', '')) AS BIGINT) AS dropped FROM seq""")
def remove_ambiguous(t):
    return t.seqs.select("seq_id", F.translate("s", "BJOUXZ", "").alias("kept"), R.count_in("s", "BJOUXZ").cast("long").alias("dropped"))


@query("P9", f"""WITH {SEQ}, {chars('seq')}
SELECT seq_id, string_agg(CASE r
 WHEN 'X' THEN substr('ARNDCQEGHILKMFPSTWYV', CAST(1 + ascii(substr(md5(seq_id || ':' || pos || ':7'), 1, 1)) * 256 + ascii(substr(md5(seq_id || ':' || pos || ':7'), 2, 1)) AS BIGINT) % 20 + 1, 1)
 WHEN 'B' THEN substr('ND', CAST(ascii(substr(md5(seq_id || ':' || pos || ':7'), 1, 1)) AS BIGINT) % 2 + 1, 1)
 WHEN 'Z' THEN substr('QE', CAST(ascii(substr(md5(seq_id || ':' || pos || ':7'), 1, 1)) AS BIGINT) % 2 + 1, 1)
 ELSE r END, '' ORDER BY pos) AS s FROM chars GROUP BY seq_id""")
def disambiguate(t):
    """Ambiguous residues drawn from their sets by a seeded hash of the position."""
    seed = 7

    def resolve(ch, i):
        h = F.md5(F.concat_ws(":", F.col("seq_id").cast("string"), (i + 1).cast("string"), F.lit(str(seed))))
        h1, h2 = F.ascii(F.substring(h, 1, 1)), F.ascii(F.substring(h, 2, 1))

        def draw(letters, v):
            return F.element_at(F.array(*[F.lit(x) for x in letters]), (v % len(letters) + 1).cast("int"))

        return (
            F.when(ch == "X", draw("ARNDCQEGHILKMFPSTWYV", 1 + h1 * 256 + h2)).when(ch == "B", draw("ND", h1))
            .when(ch == "Z", draw("QE", h1)).otherwise(ch)
        )

    return t.seqs.filter("s != ''").select("seq_id", F.array_join(F.transform(F.split("s", ""), resolve), "").alias("s"))


@query("P15 T6 F20", f"""WITH {NT}, {words('nt', 3)}, m AS (
 SELECT seq_id, pos - 1 AS p, w, (pos - 1) % 3 AS frame FROM words WHERE w IN ('ATG','TAA','TAG','TGA')),
r AS (SELECT *, coalesce(sum(CASE WHEN w <> 'ATG' THEN 1 ELSE 0 END) OVER
  (PARTITION BY seq_id, frame ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m),
g AS (SELECT seq_id, frame, run, min(p) FILTER (w = 'ATG') AS p0, min(p) FILTER (w <> 'ATG') AS p1 FROM r GROUP BY ALL)
SELECT g.seq_id, CAST(frame AS INTEGER) AS frame, CAST(p0 AS INTEGER) AS pos, CAST(coalesce(p1, length(s)) - p0 AS INTEGER) AS len
FROM g JOIN nt ON g.seq_id = nt.seq_id WHERE p0 IS NOT NULL AND coalesce(p1, length(s)) - p0 >= 90""")
def orf_from_initiation(t):
    return O.open_reading_frames(t.nts, 90, True)


@query("K25 P12", f"""WITH {NT}, {CODE}, {words('nt', 3)}, m AS (
 SELECT seq_id, pos - 1 AS p, w, (pos - 1) % 3 AS frame FROM words WHERE w IN ('ATG','TAA','TAG','TGA')),
r AS (SELECT *, coalesce(sum(CASE WHEN w <> 'ATG' THEN 1 ELSE 0 END) OVER
  (PARTITION BY seq_id, frame ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m),
g AS (SELECT seq_id, frame, run, min(p) FILTER (w = 'ATG') AS p0, min(p) FILTER (w <> 'ATG') AS p1 FROM r GROUP BY ALL),
o AS (SELECT g.seq_id, frame, p0, coalesce(p1, length(s)) - p0 AS len FROM g JOIN nt ON g.seq_id = nt.seq_id WHERE p0 IS NOT NULL AND coalesce(p1, length(s)) - p0 >= 90)
SELECT o.seq_id, concat_ws(' ', p0 + 1, p0 + len, len, frame + 1) AS line, string_agg(aa, '' ORDER BY pos) AS protein
FROM o JOIN words ON words.seq_id = o.seq_id AND pos - 1 >= p0 AND pos + 2 <= p0 + len AND (pos - 1 - p0) % 3 = 0 JOIN gcode ON w = codon GROUP BY o.seq_id, p0, len, frame""")
def orf_listing(t):
    """A line per reading frame with its ends, length and frame, and its translation."""
    d = O.open_reading_frames(t.nts, 90, True).join(t.nts.select("seq_id", "s"), "seq_id")
    cut = d.select("seq_id", "pos", "len", "frame", F.expr("substring(s, pos + 1, len)").alias("s"))
    line = F.concat_ws(" ", *[x.cast("string") for x in (F.col("pos") + 1, F.col("pos") + F.col("len"), F.col("len"), F.col("frame") + 1)])
    return cut.select("seq_id", line.alias("line"), C.translate("s").alias("protein"))


@query("P15", f"""WITH {NT}, {words('nt', 3)}, m AS (
 SELECT seq_id, pos - 1 AS p, (pos - 1) % 3 AS frame FROM words WHERE w IN ('TAA','TAG','TGA')
 UNION ALL SELECT seq_id, length(s), unnest([0, 1, 2]) FROM nt),
r AS (SELECT *, lag(p) OVER (PARTITION BY seq_id, frame ORDER BY p) AS prev FROM m)
SELECT seq_id, CAST(frame AS INTEGER) AS frame, CAST(coalesce(prev + 3, 0) AS INTEGER) AS pos,
 CAST(p - coalesce(prev + 3, 0) AS INTEGER) AS len FROM r WHERE p - coalesce(prev + 3, 0) >= 150""")
def orf_between_stops(t):
    return O.open_reading_frames(t.nts, 150, False)


TAIL_SQL = f"""WITH {NT}, {chars('nt')}, n AS (SELECT seq_id, length(s) AS n FROM nt),
x AS (SELECT seq_id, n - pos + 1 AS i, 'A' AS b, CASE WHEN r = 'A' THEN {{gain}} ELSE {{loss}} END AS v FROM chars JOIN n USING (seq_id)
 UNION ALL SELECT seq_id, pos, 'T', CASE WHEN r = 'T' THEN {{gain}} ELSE {{loss}} END FROM chars),
c AS (SELECT seq_id, b, i, sum(v) OVER (PARTITION BY seq_id, b ORDER BY i) AS sc FROM x),
m AS (SELECT *, greatest(0, max(sc) OVER (PARTITION BY seq_id, b ORDER BY i)) AS mx FROM c),
stop AS (SELECT seq_id, b, min(i) AS e FROM m WHERE sc < mx - {{thr}} GROUP BY ALL),
seen AS (SELECT m.* FROM m LEFT JOIN stop USING (seq_id, b) WHERE i <= coalesce(e, i)),
best AS (SELECT seq_id, b, max(mx) AS best, min(i) FILTER (sc = mx AND mx > {{thr}}) AS dummy FROM seen GROUP BY ALL),
pick AS (SELECT s.seq_id, s.b, any_value(best) AS best, min(CASE WHEN s.sc = best AND best > {{thr}} THEN i END) AS at
 FROM seen s JOIN best USING (seq_id, b) GROUP BY ALL),
w AS (SELECT n.seq_id, n.n, a.best AS ab, a.at AS aa, t.best AS tb, t.at AS ta FROM n
 LEFT JOIN pick a ON a.seq_id = n.seq_id AND a.b = 'A' LEFT JOIN pick t ON t.seq_id = n.seq_id AND t.b = 'T')
SELECT seq_id, CASE WHEN aa IS NOT NULL AND (ta IS NULL OR ab >= tb) THEN 'A' WHEN ta IS NOT NULL THEN 'T' ELSE 'none' END AS tail,
 CAST(CASE WHEN aa IS NOT NULL AND (ta IS NULL OR ab >= tb) THEN aa WHEN ta IS NOT NULL THEN ta ELSE 0 END AS INTEGER) AS tail_len,
 CAST(n - CASE WHEN aa IS NOT NULL AND (ta IS NULL OR ab >= tb) THEN aa WHEN ta IS NOT NULL THEN ta ELSE 0 END AS INTEGER) AS trimmed_len FROM w"""


@query("P16 W3", TAIL_SQL.format(gain=1, loss=-5, thr=3))
def polya_trim(t):
    return O.tails(t.nts, 1, -5, 3)


@query("P17 W3", TAIL_SQL.format(gain=3, loss=-6, thr=10))
def polya_report(t):
    return O.tails(t.nts, 3, -6, 10)


# Restriction enzymes, recognition sites and cut positions.
ENZYMES = [("Acc1", "GTMKAC", 3), ("Acc2", "CGCG", 3), ("Acy1", "GRCGYC", 3), ("Afl3", "ACRYGT", 2), ("Aat1", "AGGCCT", 4)]


def _site_sql():
    parts = []
    for name, site, cut in ENZYMES:
        k = len(site)
        both = [("+", R.iupac_regex(site))]
        rc = site.translate(str.maketrans(R.COMPLEMENT_FROM, R.COMPLEMENT_TO))[::-1]
        if rc != site:
            both.append(("-", R.iupac_regex(rc)))
        for strand, rx in both:
            parts.append(
                f"SELECT seq_id, '{name}' AS enzyme, '{strand}' AS strand, CAST(pos AS INTEGER) AS pos, "
                f"CAST(pos + {cut} - 1 AS INTEGER) AS cut FROM w{k} WHERE regexp_full_match(w, '{rx}')"
            )
    return f"WITH {NT}, {words('nt', 4, name='w4')}, {words('nt', 6, name='w6')} " + " UNION ALL ".join(parts)


@query("F4 F1 P24", _site_sql())
def restriction_sites(t):
    from strandframe.operators.patterns import restriction_sites as sites

    return sites(t.nts, ENZYMES)


@query("F1 P24", f"""WITH {NT}, {words('nt', 6)} SELECT seq_id, count(*) FILTER (regexp_full_match(w, 'G[AG]CG[CT]C')) AS hits
FROM words GROUP BY seq_id""")
def ambiguous_pattern_hits(t):
    return t.nts.filter(F.length("s") >= 6).select(
        "seq_id", R.overlapping_hits("s", R.iupac_regex("GRCGYC")).cast("long").alias("hits")
    )


@query("F2 F5", f"""WITH {SEQ}, {words('seq', 4)} SELECT seq_id, count(*) FILTER (regexp_full_match(w, '[ST].[^P]R')) AS hits
FROM words GROUP BY seq_id""")
def prosite_pattern_hits(t):
    return t.seqs.filter(F.length("s") >= 4).select(
        "seq_id", R.overlapping_hits("s", R.prosite_regex("[ST]-x-{P}-R")).cast("long").alias("hits")
    )


@query("F3", f"""WITH {SEQ}, {words('seq', 3)}
SELECT seq_id, CAST(pos AS INTEGER) AS pos, w AS hit FROM words WHERE w IN ('THE', 'AND', 'UND', 'LES')""")
def alternative_patterns(t):
    from strandframe.operators.patterns import find_any

    return find_any(t.seqs, ["THE", "AND", "UND", "LES"])


@query("A10 P30", f"WITH {SEQ}, {words('seq', 5, 'lang')} SELECT lang, w AS word, count(*) AS n FROM words GROUP BY ALL")
def kmer_counts(t):
    return K.word_counts(t.seqs, 5, "lang")


@query("A10", f"""WITH {SEQ}, {words('seq', 4, 'seq_id, length(s) AS n')}
SELECT w AS word, count(*) AS n FROM words WHERE pos <= n - 2 * 4 + 1 AND length(translate(w, 'ARNDCQEGHILKMFPSTWYV', '')) = 0 GROUP BY ALL""")
def kmer_counts_short_bound(t):
    return K.word_counts(t.seqs, 4, alphabet="ARNDCQEGHILKMFPSTWYV", parity=True)


@query("A10", f"""WITH {SEQ}, {words('seq', 5, 'lang')}
SELECT lang, substr(w,1,1) || substr(w,2,1) || substr(w,4,1) || substr(w,5,1) AS word, count(*) AS n FROM words GROUP BY ALL""")
def spaced_seed_counts(t):
    return K.spaced_word_counts(t.seqs, "11011", "lang")


@query("P30", f"""WITH {NT}, b AS (SELECT seq_id, s, '+' AS strand FROM nt UNION ALL SELECT seq_id, reverse(translate(s, 'ACGT', 'TGCA')), '-' FROM nt),
{CODE}, {words('b', 3, 'seq_id, strand')}, p AS (SELECT seq_id, strand, (pos-1)%3 AS frame, string_agg(aa, '' ORDER BY pos) AS s FROM words JOIN gcode ON w = codon GROUP BY ALL),
{words('p', 4, 'strand, frame', 'pw')} SELECT strand, CAST(frame AS INTEGER) AS frame, w AS word, count(*) AS n FROM pw WHERE NOT contains(w, '*') GROUP BY ALL""")
def six_frame_words(t):
    return K.frame_word_counts(t.nts, 4)


@query("A37", f"""WITH {NT}, {chars('nt')}, {words('nt', 3)}, b AS (SELECT r, count(*) AS n FROM chars GROUP BY r), tot AS (SELECT sum(n)::DOUBLE AS t FROM b),
w AS (SELECT w, count(*) AS n FROM words GROUP BY w), wt AS (SELECT sum(n)::DOUBLE AS t FROM w)
SELECT w.w AS word, w.n, round(w.n / (b1.n::DOUBLE * b2.n * b3.n / pow(tot.t, 3) * wt.t), 6) AS oe FROM w, tot, wt
JOIN b b1 ON b1.r = substr(w.w, 1, 1) JOIN b b2 ON b2.r = substr(w.w, 2, 1) JOIN b b3 ON b3.r = substr(w.w, 3, 1)""")
def word_observed_expected(t):
    return K.observed_expected(t.nts, 3).withColumn("oe", F.round("oe", 6))
