"""Query op9: the mix of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.llm import mixing as M


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, the words that the mix takes of it, and where."""
    placed, mixed = M.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return M.taken(placed, mixed).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(doc_id::VARCHAR, text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT] AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * ss / w, sid) AS i FROM w),
l AS (SELECT *, (1.5 * sum(ss) OVER () - coalesce(sum(2 * ss) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o),
k AS (SELECT min(i) AS i0, arg_min(level, i) AS lv FROM l WHERE level * w <= 2 * ss),
t AS (SELECT source, sid, ss, CASE WHEN i0 IS NULL OR i < i0 THEN (2 * ss)::DOUBLE ELSE least(lv * w, (2 * ss)::DOUBLE) END AS target FROM l, k),
p AS (SELECT r, doc_id, size, sid, ss, target, floor(target + 0.5)::BIGINT AS quota,
        (sum(size) OVER (PARTITION BY sid ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS a FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
nd AS (SELECT sid, ceil(floor(target + 0.5) / {M.BLOCK})::BIGINT AS need FROM t WHERE floor(target + 0.5) > 0),
sh AS (SELECT sid, need, sum(need) OVER (ORDER BY sid) AS high, sum(need) OVER (ORDER BY sid) - need AS low FROM nd),
nn AS (SELECT coalesce(max(high), 0)::BIGINT AS n FROM sh),
pt AS (SELECT slot, ((((slot & {(1 << 20) - 1}) + 0.5::DOUBLE) * {M._GOLDEN!r}::DOUBLE + ((slot >> 20)::DOUBLE * {M._GOLDEN_20!r}::DOUBLE) % 1.0::DOUBLE) % 1.0::DOUBLE) * n AS x FROM (SELECT unnest(range(n)) AS slot, n FROM nn)),
dr AS (SELECT slot, sid, need, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM pt JOIN sh ON low <= x AND x < high),
had AS (SELECT sid, need, least(need, (SELECT count(*) FROM dr WHERE dr.sid = nd.sid)) AS had FROM nd),
late AS (SELECT sid, had, need, coalesce(sum(need - had) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM had WHERE had < need),
slots AS (SELECT slot, sid, rank FROM dr WHERE rank < need UNION ALL SELECT n + after + rank - had, sid, rank FROM (SELECT *, unnest(range(had, need)) AS rank FROM late), nn),
pc AS (SELECT r, sid, unnest(range(first // {M.BLOCK}, (last - 1) // {M.BLOCK} + 1)) AS rank FROM (SELECT r, sid, a + z * ss AS first, least(a + z * ss + size, quota) AS last FROM p, (VALUES (0), (1)) AS zz(z)) WHERE first < last),
sl AS (SELECT r, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots FROM pc JOIN slots USING (sid, rank) GROUP BY r)
SELECT doc_id, size, ss AS source_size, target,
  (greatest(0, least(a + size, quota) - a) + greatest(0, least(a + ss + size, quota) - a - ss))::BIGINT AS taken, first_slot::BIGINT AS first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM p LEFT JOIN sl USING (r)
"""
QUERIES = {"op9_mixing": op9_mixing}
ORACLES = {"op9_mixing": OP9_SQL}
