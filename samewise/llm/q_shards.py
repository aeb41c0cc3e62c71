"""Query op11: the shard and slot of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import shards as S

LAW = "bytes"


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, checksum, shard and slot; sizes of shards are near equal."""
    placed = S.place(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


QUERIES = {"op11_sharding": op11_sharding}
ORACLES: dict[str, str] = {}
