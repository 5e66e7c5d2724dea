"""Query of the prefix trie over all conversations."""

from __future__ import annotations

from strandframe.llm import prefix_trie
from strandframe.llm.registry import corpus_query, table

#: CRC-32 of the decimal id, bit by bit, for want of a function in SQL.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
lambda a, x: list_reduce([xor(a, x), 0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295::BIGINT)"""

TRIE = f"""WITH r AS (SELECT conv_id AS c, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, d, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS i FROM r),
h AS (SELECT c, {CRC} % 6 AS h FROM (SELECT DISTINCT c FROM r)),
base AS (SELECT h.c, t.i AS p, t.d, t.n FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i <= h.h),
k AS (SELECT c, count(*) AS k FROM base GROUP BY c),
reb AS (SELECT * FROM base UNION ALL SELECT h.c, t.i - h.h + coalesce(k.k, 0), t.d, t.n FROM h JOIN t USING (c) LEFT JOIN k USING (c) WHERE t.i > h.h),
pre AS (SELECT c, p, n, string_agg(d, '/') OVER (PARTITION BY c ORDER BY p) AS key FROM reb),
rw AS (SELECT c, p AS depth, n, key, lag(key, 1, '') OVER (PARTITION BY c ORDER BY p) AS up FROM pre UNION ALL SELECT c, 0, 0, '', NULL FROM h),
node AS (SELECT key, depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(n) AS n FROM rw GROUP BY key, depth),
kid AS (SELECT up AS key, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY up),
val AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * n AS save FROM node LEFT JOIN kid USING (key)),
sub AS (SELECT r.key, sum(v.leaf) AS n_leaves, sum(v.save) AS saved_tokens FROM val v JOIN rw r ON r.c = v.conv_id AND r.depth <= v.depth GROUP BY r.key),
ends AS (SELECT key, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM (SELECT c, max_by(key, depth) AS key FROM rw GROUP BY c) GROUP BY key)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(v.n_convs AS BIGINT) AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM val v JOIN sub USING (key) LEFT JOIN node p ON p.key = v.up LEFT JOIN ends e ON e.key = v.key"""


@corpus_query(TRIE)
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
