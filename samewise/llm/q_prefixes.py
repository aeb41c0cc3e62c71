"""Query op12: the prefix trie of all conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.llm import prefixes as P

FAMILY, MOST = 5, 9


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations with its totals."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return P.trie(*P.rebuilt(talks, FAMILY, MOST)).withColumnsRenamed({"node": "conv_id", "parent": "parent_conv_id", "leaves": "n_leaves", "saved": "saved_tokens"})


#: crc32 of a decimal number, bit by bit.
_CRC = """xor(list_reduce(string_split(conv_id::VARCHAR, ''), lambda a, ch:
  list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda b, i: xor(b >> 1, 3988292384::BIGINT * (b & 1)), xor(a, ord(ch)::BIGINT)), 4294967295::BIGINT), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH e AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos FROM (SELECT *, md5(length(role) || ':' || role || text) AS digest FROM e)),
f AS (SELECT DISTINCT conv_id FROM t),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {MOST} AS h FROM f),
r AS (SELECT c.conv_id, t.pos, text, digest FROM c JOIN t ON t.conv_id = c.base WHERE pos < h UNION ALL SELECT conv_id, pos, text, digest FROM c JOIN t USING (conv_id) WHERE pos >= h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth FROM r),
p AS (SELECT conv_id, 0 AS depth, '' AS text, md5('') AS id FROM c UNION ALL
  SELECT conv_id, depth, text, md5(string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) FROM n),
v AS (SELECT depth, id, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(strlen(text)) AS own FROM p GROUP BY depth, id),
u AS (SELECT v.*, q.id AS up FROM v LEFT JOIN p AS q ON q.conv_id = v.conv_id AND q.depth = v.depth - 1),
k AS (SELECT up AS id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY ALL),
w AS (SELECT u.*, coalesce(n_children, 0) AS n_children, m.conv_id AS parent_conv_id FROM u LEFT JOIN k USING (id, depth) LEFT JOIN v AS m ON m.id = u.up AND m.depth = u.depth - 1),
s AS (SELECT p.id, p.depth, sum(w.own) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves FROM w JOIN p ON p.conv_id = w.conv_id AND p.depth <= w.depth GROUP BY p.id, p.depth),
z AS (SELECT id, depth, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS h FROM (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) JOIN p USING (conv_id, depth) GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM w JOIN s USING (id, depth) LEFT JOIN z USING (id, depth)
"""
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": OP12_SQL}
