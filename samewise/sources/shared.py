"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from samewise.errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset on one machine (tests) one is made and set. On a
    cluster a folder of one machine would lose what other machines write, so an unset folder raises there."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder that driver and executors share", master=spark.sparkContext.master)
        folder = "file://" + tempfile.mkdtemp(prefix="spark-samewise-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/samewise/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Overwrite the table at path with an empty one. Nothing that is still to run may read it: what was made of it must
    have been written already."""
    spark.range(0, 0, 1, 1).write.mode("overwrite").parquet(path)


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder, to a fresh path unless one is given, and read it back.

    This cuts lineage: a lost executor costs at most the job that writes, since later jobs read files
    that outlive it. Columns of type void are stored as strings.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    voids = {c: df[c].cast("string") for c, t in df.dtypes if t == "void"}
    df = df.withColumns(voids) if voids else df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, facts: dict[str, Column], path: str | None = None) -> tuple[DataFrame, dict]:
    """materialize, and the values of these aggregates over df, observed by the job that writes it.

    The observation stands right above the write, so it belongs to the last stage, where a partition counts once even if
    its task is repeated after a loss. Tables without a row give 0 for counts, null for other aggregates.
    """
    seen = Observation()
    stored = materialize(df.observe(seen, *[c.alias(k) for k, c in facts.items()]), name, path)
    return stored, dict(seen.get)
