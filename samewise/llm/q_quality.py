"""Query op1: certified quality rules over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import quality as Q
from samewise.sources.shared import materialize


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts and verdict. The counts are made once and kept as a small table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", Q.features(F.col("text")).alias("f"))
    table = materialize(docs, "quality")
    labelled = table.join(Q._good(spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id")
    judged = table.withColumn("verdict", Q.verdict(F.col("f"), Q.choose(Q.certify(labelled))))
    return judged.select(
        "doc_id", "f.n_words", "f.word_chars", "f.n_symbols", (F.col("f.lines.n") - F.col("f.lines.distinct")).alias("n_dup_lines"), "f.n_repeat_words",
        "verdict.base_failed", "verdict.kept", "f.n_upper", F.col("f.lines.n").alias("n_lines"),
    )


_LEVEL = Q.DELTA / len(Q.STRATA)

OP1_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
f AS (SELECT w.r, doc_id, text, len(ws) AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
        len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(ls) AS n_lines
      FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        (n_words >= {Q.STRATA[0]})::INT + (n_words >= {Q.STRATA[1]})::INT + (n_words >= {Q.STRATA[2]})::INT AS stratum,
        [least({Q.BINS}, coalesce({Q.BINS} * n_symbols // nullif(word_chars, 0), 0)),
         least({Q.BINS}, coalesce({Q.BINS} * n_upper // nullif(word_chars, 0), 0)),
         least({Q.BINS}, coalesce({Q.BINS} * n_dup_lines // nullif(n_lines, 0), 0)),
         least({Q.BINS}, coalesce({Q.BINS} * n_repeat_words // nullif(n_words, 0), 0)),
         least({Q.BINS}, coalesce(2 * word_chars // nullif(n_words, 0), 0))] AS bins FROM f),
good AS (SELECT doc_id, max(quality) >= 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
st AS (SELECT *, list_min(list_transform(range(1, {len(Q.RULES) + 1}), lambda i: CASE WHEN bins[i] > 0 THEN i * {Q.BINS} - bins[i] END)) AS first FROM b),
held AS (SELECT any_value(stratum) AS stratum, any_value(first) AS first, bool_or(good) AS good FROM st JOIN good USING (doc_id) WHERE NOT base_failed GROUP BY text),
cells AS (SELECT stratum, step, count(*) FILTER (good) AS n, count(*) FILTER (good AND first <= step) AS k, count(*) FILTER (NOT good AND first <= step) AS bad
          FROM held, range(0, {len(Q.RULES) * Q.BINS}) AS ss(step) GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n * {Q.RISK!r} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
            exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({Q.RISK!r}) + (n - i) * ln(1 - {Q.RISK!r})))) END AS tail FROM cells),
cut AS (SELECT stratum, -max({{'gain': bad - {Q.COST} * k, 'back': -step}}).back AS chosen FROM tails WHERE tail <= {_LEVEL!r} GROUP BY stratum HAVING max(bad - {Q.COST} * k) > 0)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(first <= chosen, false) AS kept,
  n_upper::BIGINT AS n_upper, n_lines::BIGINT AS n_lines
FROM st LEFT JOIN cut USING (stratum)
"""
QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": OP1_SQL}
