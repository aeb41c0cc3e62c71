"""Groups of duplicates: clustering, statistics, survivors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.components import connected_components
from samewise.operators.match import NameClasses
from samewise.operators.order import join_dealt
from samewise.operators.pairs import first_rows
from samewise.sources.shared import materialize


def number_groups(members: DataFrame) -> DataFrame:
    """members(entity_id, component) with group_id 1..k by the least entity_id of a component."""
    roots = members.groupBy("component").agg(F.min("entity_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    # groups are numbered, not rows: dealt into ranges, counted, and offset
    ranged = materialize(roots.repartitionByRange("least").select("component", "least", F.spark_partition_id().alias("p")), "roots")
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("p").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
    inside = Window.partitionBy("p").orderBy("least")
    return ranged.withColumn("i", F.row_number().over(inside)).join(offsets, "p").select("component", (F.col("before") + F.col("i")).alias("group_id"))


def cluster(entities: DataFrame, pairs: DataFrame, id_column: str = "id", name_column: str = "name") -> DataFrame:
    """Rows (entity_id, entity_name, group_id) of all entities: connected components of the pairs numbered by
    their least id, 0 for entities without a pair."""
    members = materialize(connected_components(pairs, "id1", "id2").withColumnRenamed("node", "entity_id"), "members")
    numbered = materialize(join_dealt(members, number_groups(members), "component").select(F.col("entity_id").alias("_id"), "group_id"), "groups")
    joined = entities.join(numbered, F.col(id_column) == F.col("_id"), "left")
    return joined.select(F.col(id_column).alias("entity_id"), F.col(name_column).alias("entity_name"), F.coalesce("group_id", F.lit(0)).cast("long").alias("group_id"))


def cluster_by_name(entities: DataFrame, name_pairs: DataFrame, normalised: str, id_column: str = "id", name_column: str = "name") -> DataFrame:
    """cluster() through distinct names: name_pairs(name_a, name_b) link normalised names, rows of one name are
    linked as well. Nothing is expanded into pairs of rows. entities holds the normalised name in `normalised`."""
    roots = connected_components(name_pairs, "name_a", "name_b").select(F.col("node").alias("_name"), F.col("component").alias("_c"))
    rows = entities.select(F.col(id_column).alias("entity_id"), F.col(name_column).alias("entity_name"), F.col(normalised).alias("_name"))
    tagged = materialize(join_dealt(rows, roots, "_name", "left").select("entity_id", "entity_name", F.coalesce("_c", F.when(F.col("_name") != "", F.col("_name"))).alias("component")), "tagged")
    groups = number_groups(tagged.where("component is not null").select("entity_id", "component"))
    return join_dealt(tagged, groups, "component", "left").select("entity_id", "entity_name", F.coalesce("group_id", F.lit(0)).cast("long").alias("group_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.where("group_id > 0").groupBy("group_id").agg(F.count("*").alias("size"))


def statistics(groups: DataFrame, n_pairs: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """One row of counts over entity groups; duplicate_pairs from pairs or as given."""
    per = groups.groupBy("group_id").agg(F.count("*").alias("size"), F.count_distinct("entity_id").alias("ids"))
    grouped = F.col("group_id") > 0
    out = per.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_entities"), F.count_if(grouped).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(grouped, F.col("ids"))), F.lit(0)).alias("entities_with_duplicates"),
        F.coalesce(F.avg(F.when(grouped, F.col("size"))), F.lit(0.0)).alias("average_group_size"),
        F.coalesce(F.max(F.when(grouped, F.col("size"))), F.lit(0)).alias("largest_group_size"), F.lit(1).alias("k"),
    ).withColumn("singleton_entities", F.col("total_entities") - F.col("entities_with_duplicates"))
    if pairs is not None:
        out = out.join(pairs.agg(F.count("*").alias("duplicate_pairs"), F.lit(1).alias("k")), "k")
    elif n_pairs is not None:
        out = out.withColumn("duplicate_pairs", F.lit(n_pairs).cast("long"))
    return out.drop("k")


def analyze(groups: DataFrame, include_singletons_bucket: bool = True) -> DataFrame:
    """Rows (measure, value): least, greatest, mean and median group size, and how many groups have each size 2..10.

    include_singletons_bucket counts all entities without group as one group, as the reference does.
    """
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("size"))
    if not include_singletons_bucket:
        sizes = sizes.where("group_id > 0")
    measures = {"min": F.min("size"), "max": F.max("size"), "mean": F.avg("size"), "median": F.percentile("size", F.lit(0.5))}
    measures |= {f"size_{n}": F.count_if(F.col("size") == n) for n in range(2, 11)}
    one = sizes.agg(*[v.cast("double").alias(k) for k, v in measures.items()])
    return one.select(F.explode(F.create_map(*[x for k in measures for x in (F.lit(k), F.col(k))])).alias("measure", "value"))


def entities_to_keep(groups: DataFrame, strategy: str = "first", pairs: DataFrame | None = None) -> DataFrame:
    """Column entity_id: every entity without group, and one per group: the first or last by id, or the one with
    the highest mean score of its pairs (the first on ties). Other strategies take the first."""
    grouped = groups.where("group_id > 0")
    if strategy == "highest_score" and pairs is not None:
        ends = pairs.select(F.col("id1").alias("entity_id"), "similarity_score").union(pairs.select("id2", "similarity_score"))
        means = ends.groupBy("entity_id").agg(F.avg("similarity_score").alias("mean"))
        grouped = grouped.join(means, "entity_id", "left").fillna(0.0, ["mean"])
        chosen = grouped.groupBy("group_id").agg(F.min(F.struct(-F.col("mean"), F.col("entity_id"))).alias("s")).select("s.entity_id")
    else:
        pick = F.max("entity_id") if strategy == "last" else F.min("entity_id")
        chosen = grouped.groupBy("group_id").agg(pick.alias("entity_id")).select("entity_id")
    return groups.where("group_id = 0").select("entity_id").union(chosen)


def remove_duplicates(df: DataFrame, groups: DataFrame, id_column: str = "id", strategy: str = "first", pairs: DataFrame | None = None) -> DataFrame:
    """The rows of df whose id survives; rows without id are nobody's duplicates and stay."""
    keep = entities_to_keep(groups, strategy, pairs).where("entity_id is not null").select(F.col("entity_id").alias("_kept")).distinct()
    return df.where(F.col(id_column).isNull()).union(df.join(keep, F.col(id_column) == F.col("_kept"), "left_semi"))


def removal_summary(groups: DataFrame, cleaned: DataFrame) -> DataFrame:
    """One row: counts before and after, and the share removed in percent."""
    stats = statistics(groups).select(F.col("total_entities").alias("original_count"), F.col("duplicate_groups").alias("duplicate_groups_found"), "entities_with_duplicates", F.lit(1).alias("k"))
    both = stats.join(cleaned.agg(F.count("*").alias("cleaned_count"), F.lit(1).alias("k")), "k").drop("k")
    removed = F.col("original_count") - F.col("cleaned_count")
    return both.withColumn("duplicates_removed", removed).withColumn("removal_rate", F.coalesce(F.try_divide(removed * 100.0, F.col("original_count")), F.lit(0.0)))


@dataclass
class DedupResult:
    """Entity groups, the pairs behind them and statistics (one row). Pairs may be given as classes of equal names instead
    (duplicate_pairs is None then); pairs() gives either."""

    entity_groups: DataFrame
    duplicate_pairs: DataFrame | None
    statistics: DataFrame
    classes: NameClasses | None = None

    def pairs(self) -> DataFrame:
        """The pairs; those of classes are expanded here, by whoever reads them."""
        return self.duplicate_pairs if self.classes is None else self.classes.expand().drop("at1", "at2")

    def _scores(self, strategy: str) -> DataFrame | None:
        return self.pairs() if strategy == "highest_score" else None

    def get_group(self, entity_id) -> DataFrame:
        """The members of an entity's group; an entity without group is alone in it; an unknown one gives no row."""
        own = self.entity_groups.where(F.col("entity_id") == F.lit(entity_id)).select("entity_id", "group_id")
        alone = self.entity_groups.join(own.where("group_id = 0").select("entity_id"), "entity_id", "left_semi")
        return alone.union(self.entity_groups.join(own.where("group_id > 0").select("group_id").distinct(), "group_id", "left_semi").select(alone.columns))

    def remove_duplicates(self, df: DataFrame, id_column: str = "id", strategy: str = "first") -> DataFrame:
        return remove_duplicates(df, self.entity_groups, id_column, strategy, self._scores(strategy))

    def get_entities_to_keep(self, strategy: str = "first") -> DataFrame:
        return entities_to_keep(self.entity_groups, strategy, self._scores(strategy))

    def get_removal_summary(self, cleaned: DataFrame) -> DataFrame:
        return removal_summary(self.entity_groups, cleaned)


__all__ = ["DedupResult", "analyze", "cluster", "cluster_by_name", "entities_to_keep", "first_rows", "group_sizes", "number_groups", "removal_summary", "remove_duplicates", "statistics"]
