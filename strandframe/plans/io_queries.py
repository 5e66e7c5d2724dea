"""Readers and writers exercised on texts derived from the tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from strandframe.functions import residues as R
from strandframe.operators import alignment_columns as A, statistics as S, trees as T
from strandframe.plans.alignment_queries import DIST, RUNS_SQL, SEG_SQL, SITE, pair_sql
from strandframe.plans.fragments import CELLS, QSEQ, ROWS, SEQ
from strandframe.plans.interval_queries import CRIT, dixon_ctes
from strandframe.plans.registry import query
from strandframe.plans.search_queries import nation_distances, nation_leaves
from strandframe.session import cut_lineage
from strandframe.sinks import formats as O
from strandframe.sources import lookup as L, matrices as M, records as I


@query("S1 S2 S3 S23 K4", f"""WITH {SEQ} SELECT seq_id, CASE lang WHEN 'en' THEN 'FASTA' WHEN 'de' THEN 'EMBL' WHEN 'fr' THEN 'GenBank' ELSE 'NBRF' END AS fmt,
'd' || seq_id AS name, s FROM seq""")
def flat_file_round_trip(t):
    """Every document as an entry of one of four flat-file formats, detected and parsed back."""
    name = F.concat(F.lit("d"), F.col("seq_id").cast("string"))
    s = F.col("s")
    text = F.when(F.col("lang") == "en", O.fasta(name, s)).when(F.col("lang") == "de", O.embl(name, s)).when(
        F.col("lang") == "fr", O.genbank(name, s)).otherwise(O.nbrf(name, s))
    commented = F.concat(F.lit("; derived entry\n"), text)
    return I.parse_entries(t.seqs.select("seq_id", commented.alias("entry")), "entry", "seq_id")


@query("S18 F16", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(0, length(string_split(text, chr(10))))) AS INTEGER) AS line_no FROM documents),
g AS (SELECT *, sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) + 1 AS grp FROM l)
SELECT doc_id, line_no, CAST(grp AS BIGINT) AS grp, line FROM g WHERE trim(line) <> '' AND NOT starts_with(line, ';')""")
def catalog_groups(t):
    return M.catalog_entries(t.docs.select("doc_id", "text"), "doc_id", "text")


@query("S4 S5 S10 J20", """SELECT 'd' || l.doc_id AS name, substr(text, 1 + quality * 20, 40) || substr(text, 101, 30) AS part FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def lookup_with_ranges(t):
    first = (F.col("quality") * 20 + 1).cast("string")
    spec = F.concat(first, F.lit("-"), (F.col("quality") * 20 + 40).cast("string"), F.lit(",101-130"))
    names = t.labels.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), I.parse_ranges(spec).alias("ranges"))
    db = t.docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("s"))
    return L.entries_by_name(names, db)


@query("S12 S13", """WITH own AS (SELECT s_nationkey, count(*) AS n, max(s_acctbal) AS v FROM supplier GROUP BY s_nationkey HAVING max(s_acctbal) > 8000),
com AS (SELECT n_regionkey, min(s_acctbal) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey)
SELECT s_suppkey, coalesce(own.v, com.v) AS v FROM supplier s JOIN nation n ON n_nationkey = s_nationkey LEFT JOIN own ON own.s_nationkey = s.s_nationkey LEFT JOIN com ON com.n_regionkey = n.n_regionkey""")
def parameter_fallback(t):
    nation = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    s = t.supplier.join(F.broadcast(nation), "s_nationkey").select("s_suppkey", "s_nationkey", "n_regionkey", "s_acctbal")
    own = s.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("v")).filter("v > 8000")
    common = s.groupBy("n_regionkey").agg(F.min("s_acctbal").alias("v"))
    return L.with_fallback(s, own, common, "s_nationkey", "n_regionkey", "v").select("s_suppkey", "v")


@query("S14", """WITH code AS (SELECT lower(substr(p_name, 1, 8)) AS k, min(p_brand) AS code FROM part GROUP BY 1)
SELECT p_partkey, code FROM part JOIN code ON k = lower(substr(p_name, 1, 8))""")
def taxon_code_lookup(t):
    key = F.lower(F.substring("p_name", 1, 8)).alias("k")
    code = t.part.groupBy(key).agg(F.min("p_brand").alias("code"))
    return t.part.select("p_partkey", key).join(code, "k").select("p_partkey", "code")


PHRASES = [(1, "the end"), (2, " der "), (1, " la "), (2, "?")]


@query("S27", "SELECT doc_id, CAST(CASE " + " ".join(f"WHEN contains(text, '{p}') THEN {s}" for s, p in PHRASES) + " ELSE 0 END AS INTEGER) AS strand FROM documents")
def strand_phrases(t):
    return t.docs.select("doc_id", L.strand_from_phrases("text", PHRASES).alias("strand"))


@query("S26", f"""WITH {CELLS}, f AS (SELECT msa_id, member, r = '-' AS g, lag(r = '-') OVER (PARTITION BY msa_id, member ORDER BY site) AS p FROM cells)
SELECT msa_id, member, count(*) FILTER (p IS NOT NULL AND g <> p) > 2 AS looks_aligned FROM f GROUP BY ALL""")
def aligned_input_test(t):
    flips = F.regexp_count("a", F.lit("(?<=-)[A-Z]|(?<=[A-Z])-"))
    return t.rows.filter("a != ''").select("msa_id", "member", (flips > 2).alias("looks_aligned"))


@query("F16", r"""SELECT doc_id, coalesce(string_split_regex(trim(text), '\s+')[1], '') AS head, CAST(length(string_split_regex(trim(text), '\s+')) AS BIGINT) AS words FROM documents""")
def first_word_and_count(t):
    parts = F.split(F.trim("text"), r"\s+")
    return t.docs.select("doc_id", parts[0].alias("head"), F.size(parts).cast("long").alias("words"))


@query("F18", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 1000.0::DOUBLE WHEN 2 THEN p_size * 1000000.0::DOUBLE ELSE p_size * 1000000000.0::DOUBLE END AS v FROM part")
def suffix_numbers(t):
    unit = F.element_at(F.array(*[F.lit(x) for x in ("", "k", "M", "G")]), F.col("p_size") % 4 + 1)
    return t.part.select("p_partkey", I.suffix_number(F.concat(F.col("p_size").cast("string"), unit)).alias("v"))


@query("F17", "SELECT o_orderkey, CAST(bit_count(o_orderkey) AS INTEGER) AS bits, (o_orderkey % 1000) * (o_orderkey % 1000 - 1) // 2 AS pairs FROM orders")
def bit_and_pair_counts(t):
    n = F.col("o_orderkey") % 1000
    return t.orders.select("o_orderkey", F.bit_count("o_orderkey").alias("bits"), (n * (n - 1) / 2).cast("long").alias("pairs"))


@query("J5", f"""WITH {QSEQ}, d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS idx FROM documents), q AS (SELECT q_id, row_number() OVER (ORDER BY q_id) AS idx FROM qseq)
SELECT idx, q_id, doc_id FROM d JOIN q USING (idx)""")
def zip_two_inputs(t):
    d = L.row_index(t.documents.select("doc_id"), "doc_id", 4096)
    q = L.row_index(t.benchmark.select(F.col("item_id").alias("q_id")), "q_id", 4096)
    return d.join(q, "idx").select("idx", "q_id", "doc_id")


@query("K3 K21 W1", f"""WITH {ROWS}, b AS (SELECT msa_id, member, CAST(k AS INTEGER) AS block, substr(a, CAST(k * 60 + 1 AS BIGINT), 60) AS part FROM (SELECT *, unnest(range(0, (length(a) + 59) // 60)) AS k FROM rws)),
n AS (SELECT *, CAST(sum(length(replace(part, '-', ''))) OVER (PARTITION BY msa_id, member ORDER BY block) AS BIGINT) AS last FROM b)
SELECT msa_id, block, member, lpad(CAST(last - length(replace(part, '-', '')) + 1 AS VARCHAR), 8, ' ') || ' ' || rpad(part, 60, ' ') || '| t' || member AS line FROM n""")
def interleaved_alignment(t):
    d = t.rows.select("msa_id", "member", F.posexplode(F.regexp_extract_all("a", F.lit(".{1,60}"), F.lit(0))).alias("block", "part"))
    count = F.length(R.ungap("part"))
    w = W.partitionBy("msa_id", "member").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    first = F.sum(count).over(w) - count + 1
    line = F.concat(F.lpad(first.cast("string"), 8, " "), F.lit(" "), F.rpad("part", 60, " "), F.lit("| t"), F.col("member").cast("string"))
    return d.select("msa_id", "block", "member", line.alias("line"))


@query("K4 K5", f"""WITH {ROWS} SELECT msa_id, member, rpad('c' || msa_id || 't' || member, 10, ' ') || a AS phylip, 'c' || msa_id || 't' || member || chr(9) || a AS clustal, chr(39) || 'c' || msa_id || 't' || member || chr(39) || ' ' || translate(a, '-', '.') AS nexus FROM rws""")
def typed_alignment_rows(t):
    name = F.concat(F.lit("c"), F.col("msa_id").cast("string"), F.lit("t"), F.col("member").cast("string"))
    return t.rows.select(
        "msa_id", "member", O.phylip_row(name, F.col("a")).alias("phylip"), F.concat(name, F.lit("\t"), F.col("a")).alias("clustal"),
        F.concat(F.lit("'"), name, F.lit("' "), F.translate("a", "-", ".")).alias("nexus"),
    )


@query("K14", pair_sql("consecutive", f"msa_id, i, j, printf('%8.4f %6d %6d %6d %6d', CAST({DIST} AS DOUBLE), mch, mmc, gap, unp) AS line"))
def statistic_lines(t):
    from strandframe.sinks.writers import statistic_line

    d = A.pair_statistics(A.consecutive_pairs(t.rows), "msa_id", "i", "j")
    return d.select("msa_id", "i", "j", statistic_line(*[F.col(c) for c in ("dist", "mch", "mmc", "gap", "unp")]).alias("line"))


@query("W5", SEG_SQL.replace("SELECT msa_id, site, CAST(CASE WHEN top * 2 > many THEN 3 ELSE -1 END AS BIGINT) AS v FROM site", """SELECT msa_id, site,
 CAST(CASE WHEN sum(n1 * n2) > 0 THEN 4 ELSE -1 END AS BIGINT) AS v FROM (SELECT msa_id, site, r, count(*) FILTER (role = 'user') AS n1, count(*) FILTER (role <> 'user') AS n2 FROM cells WHERE r <> '-' GROUP BY ALL) GROUP BY msa_id, site"""))
def conserved_between_groups(t):
    """Segments where the two roles of an alignment agree."""
    user = F.when(F.col("role") == "user", 1).otherwise(0)
    g = t.cells.filter("r != '-'").groupBy("msa_id", "site", "r").agg(F.sum(user).alias("n1"), F.sum(1 - user).alias("n2"))
    score = F.when(F.sum(F.col("n1") * F.col("n2")) > 0, 4).otherwise(-1).cast("long")
    return A.scoring_segments(g.groupBy("msa_id", "site").agg(score.alias("score")), 12)


@query("A31 W15", f"""WITH {CRIT}, {CELLS}, {RUNS_SQL}, p AS (SELECT x.msa_id AS k, x.member AS id, count(*) FILTER (x.r <> y.r) / count(*) AS v
FROM cells x JOIN cells y ON x.msa_id = y.msa_id AND x.site = y.site AND x.member <> y.member WHERE x.r <> '-' AND y.r <> '-' GROUP BY ALL), {dixon_ctes('p')},
gg AS (SELECT msa_id, member, count(*) AS gap_runs, CAST(sum(gln) AS BIGINT) AS gap_sites FROM gr GROUP BY ALL)
SELECT k AS msa_id, id AS member, n, side, round(value, 6) AS value, round(ratio, 6) AS ratio, gap_runs, gap_sites FROM out LEFT JOIN gg ON gg.msa_id = k AND gg.member = id""")
def member_outlier_report(t):
    """Members whose mean mismatch to the others stands out, with their gap figures."""
    d = cut_lineage(A.member_distance_sums(t.rows).filter("shared > 0").select("msa_id", "member", (F.col("mismatches") / F.col("shared")).alias("divergence")))
    out = S.dixon(d, ["msa_id"], ["member"], "divergence")
    own = t.rows.select("msa_id", "member", F.regexp_count("a", F.lit("-+")).cast("long").alias("k"), R.count_in("a", "-").cast("long").alias("s")).filter("k > 0")
    gaps = own.groupBy("msa_id", "member").agg(F.sum("k").alias("gap_runs"), F.sum("s").alias("gap_sites"))
    return out.join(gaps, ["msa_id", "member"], "left").withColumn("value", F.round("value", 6)).withColumn("ratio", F.round("ratio", 6))


@query("K15 S17")
def tree_newick(t):
    """Newick text of every region tree, written level by level and parsed back to nodes."""
    leaves = nation_leaves(t)
    text = T.newick_text(T.linkage(nation_distances(t), leaves), leaves)
    return M.newick_nodes(text, "grp", "newick").withColumn("length", F.round("length", 4))
