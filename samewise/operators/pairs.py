"""Operations on pair tables: order, symmetric duplicates, cross results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.errors import DataValidationError


def remove_symmetric(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair of ids: the one with the highest score, then the smaller id1."""
    best = Window.partitionBy(F.least("id1", "id2"), F.greatest("id1", "id2")).orderBy(F.desc("similarity_score"), "id1", "id2")
    return pairs.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def ordered(pairs: DataFrame) -> DataFrame:
    """Pairs by score, highest first; for output only."""
    return pairs.orderBy(F.desc("similarity_score"), "id1", "id2")


def first_rows(df: DataFrame, id_column: str, order_by: str | None = None) -> DataFrame:
    """One row per id, the first by order_by (else by all columns). Rows are compared in a partial aggregate, so
    an id with many rows does not gather them in one task."""
    others = [c for c in df.columns if c != id_column]
    keys = ([order_by] if order_by else []) + [c for c in others if c != order_by]
    if not keys:
        return df.select(id_column).distinct()
    least = df.groupBy(id_column).agg(F.min(F.struct(*keys)).alias("_r"))
    return least.select(*[F.col(id_column) if c == id_column else F.col("_r")[c].alias(c) for c in df.columns])


@dataclass
class CrossResult:
    """Matches between two tables and facts about each side."""

    cross_matches: DataFrame
    df1_metadata: dict = field(default_factory=dict)
    df2_metadata: dict = field(default_factory=dict)
    statistics: DataFrame | None = None

    def get_df1_matches(self, key) -> DataFrame:
        return self.cross_matches.where(F.col("df1_id") == F.lit(key))

    def get_df2_matches(self, key) -> DataFrame:
        return self.cross_matches.where(F.col("df2_id") == F.lit(key))

    def merge_datasets(self, df1: DataFrame, df2: DataFrame, how: str = "inner", suffix1: str = "_1", suffix2: str = "_2") -> DataFrame:
        return merge_datasets(self.cross_matches, df1, df2, self.df1_metadata["id_col"], self.df2_metadata["id_col"], how, suffix1, suffix2)


    def consolidate(self, df1: DataFrame, df2: DataFrame, config) -> DataFrame:
        """The main match of every entity of df1, by a ConsolidationConfig."""
        from samewise.operators.consolidate import consolidate

        return consolidate(self.cross_matches, df1, df2, self.df1_metadata["id_col"], self.df2_metadata["id_col"], config, self.df2_metadata["name_col"])

    def consolidate_by_judge(self, df1: DataFrame, client, **how) -> DataFrame:
        """The main match of every entity of df1, chosen by a language model."""
        from samewise.operators.judge import consolidate_by_judge

        return consolidate_by_judge(self.cross_matches, df1, self.df1_metadata["id_col"], client, self.df2_metadata["id_col"], **how)


def cross_matches(pairs: DataFrame) -> DataFrame:
    """Pairs under the column names of a cross result."""
    names = {"id1": "df1_id", "name1": "df1_name", "id2": "df2_id", "name2": "df2_name"}
    reason = F.col("validation_reason") if "validation_reason" in pairs.columns else F.lit("No validation")
    more = [c for c in ("matched_column1", "matched_column2") if c in pairs.columns]
    return pairs.select(*[F.col(k).alias(v) for k, v in names.items()], "similarity_score", reason.alias("validation_reason"), *more)


def cross_statistics(matches: DataFrame, df1: DataFrame, df2: DataFrame, id1: str, id2: str) -> DataFrame:
    """One row: totals, matched and unmatched entities of each side, mean score (0 without matches)."""
    side1 = df1.agg(F.count("*").alias("df1_total"), F.lit(1).alias("k"))
    side2 = df2.agg(F.count("*").alias("df2_total"), F.lit(1).alias("k"))
    m = matches.agg(
        F.count("*").alias("cross_matches"), F.count_distinct("df1_id").alias("df1_matched_entities"), F.count_distinct("df2_id").alias("df2_matched_entities"),
        F.coalesce(F.avg("similarity_score"), F.lit(0.0)).alias("avg_similarity"), F.lit(1).alias("k"),
    )
    # three tables of one row each
    one = side1.join(side2, "k").join(m, "k").drop("k")
    return one.withColumn("df1_unmatched", F.col("df1_total") - F.col("df1_matched_entities")).withColumn("df2_unmatched", F.col("df2_total") - F.col("df2_matched_entities"))


def merge_datasets(matches: DataFrame, df1: DataFrame, df2: DataFrame, id1: str, id2: str, how: str = "inner", suffix1: str = "_1", suffix2: str = "_2") -> DataFrame:
    """df1 and df2 joined through matches: df1_id, df2_id, similarity_score and all other columns, with suffixes
    where names clash. how: inner, left, right or outer, as seen from the matches."""
    if how not in ("inner", "left", "right", "outer"):
        raise DataValidationError("how is inner, left, right or outer", how=how)
    keys = matches.select("df1_id", "df2_id", "similarity_score")
    taken = {"df1_id", "df2_id", "similarity_score"}
    clash = ({*df1.columns} & {*df2.columns}) | (taken & ({*df1.columns} | {*df2.columns}))
    a = df1.select([F.col(c).alias(c + suffix1 if c in clash else c) for c in df1.columns])
    b = df2.select([F.col(c).alias(c + suffix2 if c in clash else c) for c in df2.columns])
    k1, k2 = id1 + suffix1 if id1 in clash else id1, id2 + suffix2 if id2 in clash else id2
    return keys.join(a, keys["df1_id"] == a[k1], how).join(b, F.col("df2_id") == b[k2], how)
