"""Query op5: main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm.html import extract


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op5_html_text": op5_html_text}
#: Not in SQL; tests compare with known texts.
ORACLES: dict[str, str] = {}
