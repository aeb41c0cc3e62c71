"""Query op6: pages written as WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import warc as W
from samewise.sources.shared import materialize, new_path


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its capture read back; revisits take length and page from the response they refer to."""
    path = new_path(spark, "warc")
    W.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    records = materialize(W.read_archives(spark, path, with_payload=False).drop("payload"), "records")
    page = F.try_element_at(F.element_at("metadata", 1)["fields"], F.lit("page-id")).cast("long")
    found = W.captures(records).select("record_id", "response", page.alias("page_id"))
    target = found.where("response.type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("target_page"), F.col("response.payload_bytes").alias("target_bytes"), F.col("response.payload_sha1").alias("target_sha1"))
    # a response is its own target, so that rows that refer to nothing do not meet in one task
    joined = found.join(target, F.coalesce("response.refers_to", "record_id") == F.col("target"), "left")
    return joined.select(
        "page_id", F.coalesce("response.payload_bytes", "target_bytes").alias("payload_bytes"), F.coalesce("response.payload_sha1", "target_sha1").alias("payload_digest"),
        F.col("response.type").alias("record_type"), F.when(F.col("response.refers_to").isNotNull(), F.col("target_page")).alias("refers_to"), (F.col("response.payload_digest") == F.concat(F.lit("sha1:"), F.coalesce("response.payload_sha1", "target_sha1"))).alias("digest_matches"),
    )


OP6_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY sha1(html)) AS keeper FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes < {W.REVISIT_BYTES} OR page_id IS NOT DISTINCT FROM keeper OR keeper IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes >= {W.REVISIT_BYTES} AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to, true AS digest_matches
FROM k
"""
QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": OP6_SQL}
