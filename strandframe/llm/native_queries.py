"""Queries of the operators that use DataFrame functions only, over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.llm import line_quality as Q, sharding
from strandframe.llm.registry import corpus_query, table

#: Bytes of text in a shard of the registered query: small, as the given tables are; a cluster takes 256 MB or so.
SHARD_BYTES = 1 << 20

SHARDS = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(strlen(text), 0) AS bytes,
CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
b AS (SELECT rid, doc_id, bytes, h, 0 AS depth, sum(bytes) OVER () AS total, min(h) OVER () = max(h) OVER () AS single FROM d
UNION ALL SELECT rid, doc_id, bytes, h, depth + 1, sum(bytes) OVER (PARTITION BY h >> (59 - depth)), min(h) OVER (PARTITION BY h >> (59 - depth)) = max(h) OVER (PARTITION BY h >> (59 - depth))
FROM b WHERE total > {SHARD_BYTES} AND NOT single),
f AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY depth DESC) AS k FROM b)
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(h >> (60 - depth)), depth, '0') END || CASE WHEN single AND total > {SHARD_BYTES} THEN '.' || bytes || '.0' ELSE '' END AS shard,
depth, CAST(bytes AS BIGINT) AS n_bytes, CAST(total AS BIGINT) AS shard_bytes FROM f WHERE k = 1"""


@corpus_query(SHARDS)
def op6_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


BOIL = " OR ".join([f"(length(line) <= {Q.FILLS * len(p)} AND contains(lower(line), '{p}'))" for p in Q.BOILERPLATE] + [
    f"(length(line) <= {Q.FILLS * Q.YEAR} AND regexp_matches(lower(line), '{Q.COPYRIGHT}'))"])
QUALITY = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \x09-\x0D]+', '', 'g') <> '') AS l FROM d),
g AS (SELECT rid, k, array_to_string(w[k:k + 4], ' ') AS s FROM w, unnest(range(1, len(w) - 3)) AS u(k)),
r AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(*) AS n_repeat_words FROM (SELECT DISTINCT rid, unnest(range(k, k + 5)) AS p FROM r) GROUP BY rid),
x0 AS (SELECT rid, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM w), x1 AS (SELECT *, regexp_matches(line, 'FRAG') AND NOT regexp_matches(line, 'SENT') AS f FROM x0),
x AS (SELECT rid, line, f AND ((lag(f, 1, false) OVER o AND (lag(f, 2, false) OVER o OR lead(f, 1, false) OVER o)) OR (lead(f, 1, false) OVER o AND lead(f, 2, false) OVER o)) AS row3 FROM x1 WINDOW o AS (PARTITION BY rid ORDER BY k)),
good AS (SELECT rid, sum(length(regexp_replace(line, '[ \x09-\x0D]+', '', 'g'))) AS stay FROM x
WHERE NOT (row3 OR regexp_matches(lower(line), 'NAV') OR BOIL OR regexp_matches(line, 'SHOUT')
OR 2 * length(regexp_replace(line, '[^\p{L}\p{N}]+', '', 'g')) < length(regexp_replace(line, '\s+', '', 'g'))) GROUP BY rid),
a AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(stay, 0) AS BIGINT) AS stay FROM d JOIN w USING (rid) LEFT JOIN n USING (rid) LEFT JOIN good USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN round(1 - stay / word_chars::DOUBLE, 6) ELSE 0.0 END AS lost FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept, CAST(lost AS DOUBLE) AS lost FROM b""".replace("NAV", Q.NAVIGATION).replace("BOIL", BOIL).replace("FRAG", Q.FRAGMENT).replace("SENT", Q.SENTENCE.replace("'", "''")).replace("SHOUT", Q.SHOUT)


@corpus_query(QUALITY)
def op9_line_quality(spark, sf_dir):
    return Q.line_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("lost"))
