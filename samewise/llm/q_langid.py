"""Query op4: language of every document, learned from the folds that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import langid as L


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language and margin; fold 2 of crc32(doc_id) mod 4 is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    dictionaries = L.train(docs.where(~held).select("text", "lang"))
    found = L.identify(docs.select("doc_id", "text", held.alias("held_out")), dictionaries)
    return found.select("doc_id", "held_out", "language.lang_pred", F.col("language.margin").alias("score"), (~L.accepted(F.col("language"))).alias("rejected"))


QUERIES = {"op4_language_id": op4_language_id}
#: Compression is not in SQL; tests compare with a brute-force version and held-out accuracy.
ORACLES: dict[str, str] = {}
