"""Query op7: verdict on the url of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.llm import urls as U

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return U.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), RULES)[0]


_D, _ROUNDS = U.DAMPING, 60

_CASES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1])))
OP7_SQL = rf"""
WITH RECURSIVE a AS (SELECT page_id, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, html, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
p AS (SELECT *, CASE {_CASES} END AS rule FROM c),
v AS (SELECT *, CASE rule {" ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)} END AS verdict FROM p),
shares AS (SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS bad FROM v WHERE host <> '' GROUP BY host),
raw AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(
    regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1), lambda h: translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst
  FROM v WHERE host <> '') WHERE src <> dst GROUP BY ALL),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS forth, n / sum(n) OVER (PARTITION BY dst) AS back FROM raw),
seeds AS (SELECT host, max(good) AS good, max(bad) AS bad FROM (SELECT * FROM shares UNION ALL SELECT dst, 0.0, 0.0 FROM raw) GROUP BY host),
steps AS (SELECT src AS a, dst AS b, forth AS t, 0.0::DOUBLE AS d, 0.0::DOUBLE AS l, back AS k FROM edges UNION ALL SELECT dst, src, 0.0, back, forth, 0.0 FROM edges
  UNION ALL SELECT host, host, 0.0, 0.0, 0.0, 0.0 FROM seeds),
r(i, host, t, d, l, k) AS (SELECT 0, host, ({1 - _D!r} * good)::DOUBLE, ({1 - _D!r} * bad)::DOUBLE, bad::DOUBLE, good::DOUBLE FROM seeds UNION ALL
  SELECT g.i, s.host, {1 - _D!r} * s.good + {_D!r} * g.t, {1 - _D!r} * s.bad + {_D!r} * g.d, greatest(s.bad, {_D!r} * g.l), greatest(s.good, {_D!r} * g.k)
  FROM (SELECT r.i + 1 AS i, b, sum(r.t * st.t) AS t, sum(r.d * st.d) AS d, sum(r.l * st.l) AS l, sum(r.k * st.k) AS k FROM r JOIN steps st ON st.a = r.host WHERE r.i < {_ROUNDS} GROUP BY r.i, b) g
  JOIN seeds s ON s.host = g.b)
SELECT page_id, v.host, path, rule, coalesce(verdict, CASE WHEN d >= {U.THRESHOLD * (1 - _D)!r} AND d > t OR l >= {U.THRESHOLD!r} AND (d > t OR s.good = 0 AND l > k) THEN 'block' END, 'allow') AS verdict
FROM v LEFT JOIN r ON r.host = v.host AND r.i = {_ROUNDS} LEFT JOIN seeds s ON s.host = v.host
"""
QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES = {"op7_url_filter": OP7_SQL}
