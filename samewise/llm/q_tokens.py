"""Query op3: token counts of documents under a public vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from samewise.llm import tokens as T

#: The vocabulary file, read by the driver.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op3_token_counts(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document with its numbers of words and tokens."""
    return T.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), T.load_vocabulary(model))


QUERIES = {"op3_token_counts": op3_token_counts}
#: Not in SQL; tests compare with a public unigram implementation.
ORACLES: dict[str, str] = {}
