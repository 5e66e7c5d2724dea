"""Gene-structure queries: texts as loci, letter runs as exons."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import codons as C, residues as R, runs as U
from strandframe.operators import genes as G, composition as K
from strandframe.plans.fragments import NT, ROWS, SEQ, chars, words
from strandframe.plans.registry import query

EXONS = """gch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, CAST(unnest(range(0, length(text))) AS BIGINT) AS p FROM documents WHERE length(text) > 0),
gl AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM gch WHERE regexp_full_match(c, '[A-Za-z]')),
gr AS (SELECT doc_id, min(p) AS l, max(p) + 1 AS r FROM gl GROUP BY doc_id, k),
ex AS (SELECT doc_id AS id, row_number() OVER w AS exon_no, l, r, CAST(sum(r - l) OVER w AS BIGINT) AS cds_r, CAST(sum(r - l) OVER w - (r - l) AS BIGINT) AS cds_l
 FROM gr WINDOW w AS (PARTITION BY doc_id ORDER BY l))"""
INTR = f"""{EXONS}, intr AS (SELECT id, exon_no AS intron_no, r AS l, lead(l) OVER (PARTITION BY id ORDER BY exon_no) AS r, cds_r AS pos, cds_r % 3 AS phase FROM ex)"""


def as_long(df):
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


@query("K9 F21", f"WITH {EXONS} SELECT * FROM ex")
def exon_table(t):
    return as_long(G.exons(t.docs, "doc_id"))


@query("K9 W13", f"WITH {INTR} SELECT id, intron_no, l, r, pos, phase FROM intr WHERE r IS NOT NULL")
def intron_table(t):
    return as_long(G.introns(t.docs, "doc_id"))


@query("K6", f"""WITH {EXONS} SELECT 'doc' || id || chr(9) || 'text' || chr(9) || 'cds' || chr(9) || (l + 1) || chr(9) || r || chr(9) || '.' || chr(9) || '+' || chr(9)
 || CASE cds_l % 3 WHEN 0 THEN '0' WHEN 1 THEN '2' ELSE '1' END || chr(9) || 'ID=cds' || id || '.' || exon_no || ';Parent=doc' || id AS line FROM ex""")
def gff3_lines(t):
    from strandframe.sinks.formats import gff3_cds

    return gff3_cds(G.exons(t.docs, "doc_id"))


@query("K7", f"""WITH {EXONS} SELECT 'doc' || id || chr(9) || min(l) || chr(9) || max(r) || chr(9) || 'doc' || id || chr(9) || '0' || chr(9) || '+' || chr(9) || min(l) || chr(9) || max(r)
 || chr(9) || '0' || chr(9) || count(*) || chr(9) || string_agg(CAST(r - l AS VARCHAR), ',' ORDER BY l) || chr(9) || string_agg(CAST(l - l0 AS VARCHAR), ',' ORDER BY l) AS line
FROM (SELECT *, min(l) OVER (PARTITION BY id) AS l0 FROM ex) GROUP BY id""")
def bed12_lines(t):
    from strandframe.sinks.formats import bed12

    return bed12(G.exon_arrays(t.docs, "doc_id"))


@query("S20 K11", f"""WITH {EXONS} SELECT ex.id, any_value(lang <> 'en') AS minus, count(*) AS exons, CAST(sum(r - l) AS BIGINT) AS letters, CAST(max(r) AS BIGINT) AS last
FROM ex JOIN documents ON doc_id = ex.id GROUP BY ex.id""")
def structure_line_reader(t):
    """Entries with ``;C`` lines are written and read back: strand, exons and their ends."""
    from strandframe.sinks.formats import fasta, structure_lines
    from strandframe.sources.genes import parse_structure

    d = t.docs.filter(F.col("text").rlike(U.LETTER)).select(F.col("doc_id").alias("id"), (F.col("lang") != "en").alias("rev"), U.runs("text").alias("exons"), R.letters("text").alias("s"))
    entry = F.concat(F.lit(">entry\n"), structure_lines("exons", F.col("rev")), F.lit("\n"), fasta(F.lit("residues"), F.col("s")))
    d = d.select("id", entry.alias("entry")).select("id", parse_structure("entry").alias("x"))
    total = F.aggregate("x.exons", F.lit(0).cast("long"), lambda a, e: a + e["r"] - e["l"])
    return d.select("id", "x.minus", F.size("x.exons").cast("long").alias("exons"), total.alias("letters"), F.element_at("x.exons", -1)["r"].cast("long").alias("last"))


@query("K11 F21 S19", f"""WITH {EXONS} SELECT id, 'join(' || string_agg((l + 1) || '..' || r, ',' ORDER BY l) || ')' AS feature, CAST(sum(r - l) AS BIGINT) AS parsed_length, count(*) AS parsed_exons FROM ex GROUP BY id""")
def cds_features(t):
    """Feature text is written, parsed back, and the parsed ranges are measured."""
    from strandframe.sinks.formats import cds_join
    from strandframe.sources.genes import parse_join

    d = G.exon_arrays(t.docs, "doc_id").select("id", cds_join("exons").alias("feature"))
    parsed = d.withColumn("x", parse_join("feature"))
    return parsed.select(
        "id", "feature", F.aggregate("x", F.lit(0).cast("long"), lambda a, e: a + e["r"] - e["l"]).alias("parsed_length"),
        F.size("x").cast("long").alias("parsed_exons"),
    )


@query("K10 D16", f"""WITH {EXONS}, b AS (SELECT id, l, r, lead(l) OVER (PARTITION BY id ORDER BY l) AS nl FROM ex)
SELECT id, string_agg((r - l) || 'M' || CASE WHEN nl IS NOT NULL THEN (nl - r) || 'N' ELSE '' END, '' ORDER BY l) AS cigar FROM b GROUP BY id""")
def cigar_strings(t):
    from strandframe.sinks.formats import cigar

    return G.exon_arrays(t.docs, "doc_id").select("id", cigar("exons").alias("cigar"))


@query("P6 S5 G4", f"""WITH {SEQ} SELECT d.doc_id, substr(text, 3, 20) || substr(text, 41, 60) || substr(text, 201, 150) AS spliced FROM documents d""")
def splice_ranges(t):
    """Range text ``3-22,41-100,201-350`` parsed to slices and concatenated."""
    from strandframe.sources.records import parse_ranges, splice

    d = t.docs.withColumn("ranges", parse_ranges(F.lit("3-22,41-100,201-350")))
    return d.select("doc_id", splice("text", "ranges").alias("spliced"))


@query("P32", f"""WITH {NT}, {words('nt', 3)}, g AS (SELECT seq_id, count(*) FILTER (w IN ('TAA','TAG','TGA') AND (pos-1)%3=0) AS stops,
 max(pos) FILTER ((pos-1)%3=0) AS last FROM words GROUP BY seq_id), z AS (SELECT g.seq_id, count(*) AS term FROM g JOIN words ON g.seq_id = words.seq_id AND pos = last AND w IN ('TAA','TAG','TGA') GROUP BY ALL)
SELECT g.seq_id, stops - coalesce(term, 0) AS premature, CAST(length(s) % 3 AS BIGINT) AS frame_excess FROM g JOIN nt USING (seq_id) LEFT JOIN z USING (seq_id)""")
def premature_stops(t):
    d = t.nts.filter(F.length("s") >= 3).select("seq_id", C.translate("s").alias("p"), (F.length("s") % 3).cast("long").alias("frame_excess"))
    return d.select("seq_id", (R.count_in("p", "*") - F.when(F.endswith("p", F.lit("*")), 1).otherwise(0)).cast("long").alias("premature"), "frame_excess")


@query("P31", """WITH g AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+') AS x FROM documents),
w AS (SELECT doc_id, unnest(x) AS a, unnest(x[2:]) AS b FROM g)
SELECT lower(right(a, 2) || left(b, 2)) AS junction, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""")
def junction_words(t):
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    pairs = t.docs.select(w.alias("a")).select(F.inline(F.arrays_zip("a", F.slice("a", F.lit(2), F.size("a")).alias("b"))).alias("a", "b"))
    return pairs.filter("b IS NOT NULL").groupBy(F.lower(F.concat(F.right("a", F.lit(2)), F.left("b", F.lit(2)))).alias("junction")).agg(F.count("*").alias("n"))


@query("W13", f"""WITH {NT}, {words('nt', 2)} SELECT seq_id, CASE w WHEN 'GT' THEN 'donor' WHEN 'GC' THEN 'weak donor' WHEN 'AT' THEN 'rare donor' WHEN 'AG' THEN 'acceptor' WHEN 'AC' THEN 'rare acceptor' ELSE 'none' END AS site_class,
count(*) AS n FROM words GROUP BY ALL""")
def splice_site_classes(t):
    d = K.word_counts(t.nts, 2, "seq_id")
    names = F.create_map(*[F.lit(x) for p in (("GT", "donor"), ("GC", "weak donor"), ("AT", "rare donor"), ("AG", "acceptor"), ("AC", "rare acceptor")) for x in p])
    return d.groupBy("seq_id", F.coalesce(names[F.col("word")], F.lit("none")).alias("site_class")).agg(F.sum("n").alias("n"))


SETS = f"""{ROWS}, ic AS (SELECT msa_id, member, role, unnest(regexp_extract_all(a, '[A-Z]+')) AS w, unnest(range(1, length(regexp_extract_all(a, '[A-Z]+')) + 1)) AS i FROM rws),
ip AS (SELECT *, CAST(sum(length(w)) OVER (PARTITION BY msa_id, member ORDER BY i) AS BIGINT) AS pos, CAST(sum(length(w)) OVER (PARTITION BY msa_id, member) AS BIGINT) AS cds_len FROM ic),
ii AS (SELECT msa_id, member, role, pos, cds_len FROM ip WHERE pos < cds_len)"""


@query("A25 S30 K19", f"WITH {SETS} SELECT msa_id, pos, count(*) AS owners, count(*) = 1 AS lone FROM ii GROUP BY ALL")
def intron_matrix(t):
    return G.intron_sets(t.rows).groupBy("msa_id", "pos").agg(F.count("*").alias("owners")).withColumn("lone", F.col("owners") == 1)


@query("A26 A28 G11", f"""WITH {SETS}, n AS (SELECT msa_id, pos, count(*) AS k, sum(cds_len) AS w, sum(cds_len * cds_len) AS w2 FROM ii GROUP BY ALL)
SELECT msa_id, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS common_pairs, CAST(sum((w * w - w2) // 2) AS BIGINT) AS weighted_bonus FROM n GROUP BY msa_id""")
def common_intron_pairs(t):
    n = G.intron_sets(t.rows).groupBy("msa_id", "pos").agg(
        F.count("*").alias("k"), F.sum("cds_len").alias("w"), F.sum(F.col("cds_len") * F.col("cds_len")).alias("w2")
    )
    return n.groupBy("msa_id").agg(
        F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("long")).alias("common_pairs"),
        F.sum(((F.col("w") * F.col("w") - F.col("w2")) / 2).cast("long")).alias("weighted_bonus"),
    )


@query("A27", f"""WITH {SETS}, p AS (SELECT msa_id, member // 2 AS pair, pos, max(CASE WHEN member % 2 = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN member % 2 = 1 THEN 1 ELSE 0 END) AS b FROM ii GROUP BY ALL)
SELECT msa_id, pair, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(a * b) AS BIGINT) AS c, round((sum(a) + sum(b) - 2 * sum(a * b)) / (sum(a) + sum(b))::DOUBLE, 6) AS dist FROM p GROUP BY ALL""")
def intron_set_distance(t):
    return G.set_distance(G.intron_sets(t.rows)).withColumn("dist", F.round("dist", 6))


@query("A38", f"WITH {SETS} SELECT msa_id, member, pos, cds_len - pos AS to_end FROM ii")
def intron_to_gene_end(t):
    return G.intron_sets(t.rows).select("msa_id", "member", "pos", (F.col("cds_len") - F.col("pos")).alias("to_end"))


@query("A39", f"WITH {SETS} SELECT role, pos, count(*) AS introns, count(DISTINCT msa_id) AS genes FROM ii GROUP BY ALL")
def intron_taxon_summary(t):
    per = G.intron_sets(t.rows).groupBy("role", "pos", "msa_id").agg(F.count("*").alias("k"))
    return per.groupBy("role", "pos").agg(F.sum("k").alias("introns"), F.count("*").alias("genes"))


# Kyte-Doolittle hydropathy in tenths, order of the amino acid letters.
HYDROPATHY = [18, -45, -35, -35, 25, -35, -35, -4, -32, 45, 38, -39, 19, 28, -16, -8, -7, -9, -13, 42]
HYDRO_CASE = " ".join(f"WHEN '{a}' THEN {v}" for a, v in zip(R.AMINO, HYDROPATHY))


@query("W12", f"""WITH {SEQ}, {chars('seq')}, v AS (SELECT seq_id, pos, CASE r {HYDRO_CASE} ELSE 0 END AS v FROM chars),
s AS (SELECT seq_id, pos, sum(v) OVER w AS s, count(*) OVER w AS k FROM v WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING))
SELECT seq_id, CAST(max(s) AS BIGINT) AS max_sum, CAST(min(s) AS BIGINT) AS min_sum, CAST(arg_max(pos, (s, -pos)) AS BIGINT) AS at FROM s WHERE k = 17 GROUP BY seq_id""")
def hydropathy_windows(t):
    from strandframe.operators.windows import sliding_extremes

    return sliding_extremes(t.seqs, dict(zip(R.AMINO, HYDROPATHY)), 17)


# An example matrix: integer position weights around a start, one column per position (A C G T).
START_CONTEXT = [(3, 1, 2, 0), (1, 3, 1, 0), (4, 0, 2, 0), (9, -9, -9, -9), (-9, -9, -9, 9), (-9, -9, 9, -9), (1, 0, 3, 0)]
PWM_ROWS = ", ".join(f"({i + 1}, '{b}', {v})" for i, c in enumerate(START_CONTEXT) for b, v in zip("ACGT", c))


@query("W8", f"""WITH {NT}, pwm(c, r, v) AS (VALUES {PWM_ROWS}), {words('nt', 7)},
u AS (SELECT seq_id, pos, unnest(string_split(w, '')) AS r, unnest(range(1, 8)) AS c FROM words),
s AS (SELECT seq_id, pos, sum(v) AS s FROM u JOIN pwm USING (c, r) GROUP BY ALL)
SELECT seq_id, CAST(max(s) AS BIGINT) AS best, CAST(min(pos) FILTER (s = m) AS BIGINT) AS at FROM (SELECT *, max(s) OVER (PARTITION BY seq_id) AS m FROM s) GROUP BY seq_id""")
def weight_matrix_best_hit(t):
    from strandframe.operators.windows import weight_matrix_hits

    return weight_matrix_hits(t.nts, "ACGT", START_CONTEXT)


@query("W9 W10 W11", f"""WITH {NT}, {words('nt', 6)}, tab AS (SELECT w, count(*) FILTER ((pos-1)%3=0) * 1000 // count(*) - 333 AS v FROM words GROUP BY w)
SELECT seq_id, (pos-1)%3 AS phase, CAST(sum(v) AS BIGINT) AS potential FROM words JOIN tab USING (w) GROUP BY ALL""")
def coding_potential(t):
    from strandframe.operators.windows import hexamer_table, phase_potential

    return phase_potential(t.nts, hexamer_table(t.nts))


@query("W10 W11", f"""WITH {NT}, {chars('nt')}, v AS (SELECT seq_id, pos, CASE r WHEN 'G' THEN 2 WHEN 'C' THEN 2 ELSE -1 END AS v FROM chars),
s AS (SELECT seq_id, pos, sum(v) OVER (PARTITION BY seq_id ORDER BY pos) AS p FROM v)
SELECT seq_id, CAST(max(p) AS BIGINT) AS peak, CAST(arg_min(pos, (-p, pos)) AS BIGINT) AS peak_at, CAST(arg_max(p, pos) AS BIGINT) AS total FROM s GROUP BY seq_id""")
def cumulative_potential(t):
    from strandframe.operators.windows import cumulative_peak

    return cumulative_peak(t.nts, {"G": 2, "C": 2}, -1)
