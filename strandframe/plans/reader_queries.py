"""Text readers on texts derived from the tables, and gap openings between groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import residues as R
from strandframe.operators import alignment_columns as A, genes as G
from strandframe.plans.fragments import CELLS
from strandframe.plans.gene_queries import EXONS
from strandframe.plans.registry import query
from strandframe.plans.search_queries import PROFILE, nation_distances
from strandframe.sinks.formats import gff3_cds
from strandframe.sources import genes as S, matrices as M


@query("S15", f"WITH {PROFILE} SELECT grp, 'n' || i AS name_i, 'n' || j AS name_j, round(d, 6) AS d FROM dm")
def distance_text_reader(t):
    """Each region's distances as names, a blank line and a lower triangle, read back."""
    name = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    names = t.nation.groupBy(F.col("n_regionkey").alias("grp")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", name.alias("n")))), lambda x: x["n"]), "\n").alias("names"))
    cell = F.struct("i", F.format_string("%.6f", "d").alias("t"))
    line = nation_distances(t).groupBy("grp", "j").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["t"]), " ").alias("line"))
    body = line.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "line"))), lambda x: x["line"]), "\n").alias("body"))
    texts = names.join(body, "grp").select("grp", F.concat("names", F.lit("\n\n"), "body", F.lit("\n")).alias("text"))
    return M.distance_matrices(texts, "grp", "text").select("grp", "name_i", "name_j", "d")


@query("S16", "SELECT 'p' || l_partkey AS u, 's' || l_suppkey AS v, l_quantity AS value FROM lineitem WHERE l_returnflag <> 'R'")
def edge_text_reader(t):
    """Line items as lines of an edge list, returned ones as comment lines, read back."""
    line = F.format_string("%d %.2f p%d s%d", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")
    lines = t.lineitem.select(F.when(F.col("l_returnflag") == "R", F.concat(F.lit(">"), line)).otherwise(line).alias("value"))
    return M.edges_from_text(lines, "value", 2)


CDS = "regexp_replace(text, '[^A-Za-z]', '', 'g')"


@query("S21 S19 K6", f"""WITH {EXONS}, f AS (SELECT id, 'join(' || string_agg((l + 1) || '..' || r, ',' ORDER BY l) || ')' AS x FROM ex GROUP BY id)
SELECT id AS seq_id, CASE WHEN id % 2 = 1 THEN 'complement(' || x || ')' ELSE x END AS feature,
CASE WHEN id % 2 = 1 THEN reverse(translate({CDS}, '{R.COMPLEMENT_FROM}', '{R.COMPLEMENT_TO}')) ELSE {CDS} END AS cds FROM f JOIN documents ON doc_id = id""")
def gene_structured_entries(t):
    """Exons as GFF3 lines, odd documents on the minus strand, read back and joined with their sequences."""
    lines = gff3_cds(G.exons(t.docs, "doc_id"))
    odd = F.substring_index("line", "\t", 1).substr(F.lit(4), F.lit(20)).cast("long") % 2 == 1
    value = F.when(odd, F.replace("line", F.lit("\t+\t"), F.lit("\t-\t"))).otherwise(F.col("line"))
    seqs = t.docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("seq_id"), F.col("text").alias("s"))
    d = S.genes_with_sequence(S.gff_genes(lines.select(value.alias("value"))), seqs)
    return d.select(F.substring("seq_id", 4, 20).cast("long").alias("seq_id"), "feature", "cds")


@query("A22 D14", f"""WITH {CELLS}, k AS (SELECT *, site - 1 - coalesce(max(CASE WHEN r <> '-' THEN site END) OVER (PARTITION BY msa_id, member ORDER BY site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM cells),
g AS (SELECT x.msa_id, count(*) AS openings FROM k x JOIN k y ON x.msa_id = y.msa_id AND x.site = y.site AND (x.role = 'user') <> (y.role = 'user') WHERE x.r = '-' AND y.r <> '-' AND y.before >= x.before GROUP BY x.msa_id)
SELECT * FROM g""")
def gap_openings_between_groups(t):
    """Gap openings between the two roles of an alignment from state frequencies, against SQL that pairs the members."""
    return A.gap_openings(t.rows, F.col("role") == "user")
