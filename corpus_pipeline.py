"""A training corpus from documents: quality, language, near-duplicates, benchmark leaks, mix.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents; the last returns each kept document with its place in the mix. Rows are dropped
for what they are, so repeated rows, nulls and extra columns pass as the operators' docstrings say.

Edge cases: an empty table stays empty in every stage; without labels only the base rules reject, without benchmark items
nothing leaks; null and empty texts fail the base rules; of near-duplicates with one doc_id a single row stays; texts equally
near to two languages have no margin and go; very long texts are read whole; columns that bear names which operators use
inside are carried along unharmed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.llm import decontam, langid, mixing, quality, simhash
from samewise.sources.shared import materialize


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what fails the base rules or a certified cutoff; cutoffs are fitted to the labels of docs."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(F.col(judged.columns[-1])["kept"]).select(*_columns(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language or with a narrow margin; dictionaries are learned from docs with a lang."""
    found = langid.identify(docs, langid.train(docs.select("doc_id", "text", "lang")))
    return found.where(langid.accepted(F.col(found.columns[-1]))).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each component of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its size, its source's size and target, and the words that the mix takes of it."""
    placed, mixed = mixing.mix(docs.select("doc_id", "text", "source"))
    return mixing.taken(placed, mixed)


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression and XXH64 are not in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
