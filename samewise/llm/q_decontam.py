"""Query op10: benchmark items found in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.llm import decontam as D


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return D.pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def _shingles(table: str, key: str) -> str:
    return rf"""SELECT DISTINCT {key}, array_to_string(ws[i:i + {D.WORDS - 1}], ' ') AS s FROM
      (SELECT {key}, ws, unnest(range(1, len(ws) - {D.WORDS - 2})) AS i FROM
        (SELECT {key}, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM {table}))"""


OP10_SQL = f"""
WITH d AS ({_shingles("documents", "doc_id")}),
b AS ({_shingles("benchmark", "item_id")}),
q AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / any_value(n)::DOUBLE AS containment
FROM d JOIN b USING (s) JOIN q USING (item_id) GROUP BY doc_id, item_id
HAVING {D.SHARE[1]} * count(*) >= {D.SHARE[0]} * any_value(n)
"""
QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES = {"op10_decontamination": OP10_SQL}
