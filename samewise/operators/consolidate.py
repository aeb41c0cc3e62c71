"""Consolidation: the main match of every entity of the left table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from samewise.errors import ConfigurationError
from samewise.operators.order import spread
from samewise.operators.pairs import first_rows


@dataclass
class ConsolidationConfig:
    """mode strict takes the best priority, then score; threshold only among matches within priority_threshold of
    the best score. Without priority_column and priority_order the best score wins."""

    enabled: bool = False
    priority_column: str | None = None
    priority_column_source: str = "df2"
    priority_order: list = field(default_factory=list)
    priority_mode: str = "strict"
    priority_threshold: float = 10.0
    df1_metadata_columns: list[str] = field(default_factory=list)
    df2_metadata_columns: list[str] = field(default_factory=list)
    keep_all_matches: bool = True
    filter_function: Column | Callable[[], Column] | None = None
    selection_function: Callable[[pd.DataFrame], pd.Series] | None = None


def _side(df: DataFrame, key: str, columns: list[str], suffix: str, taken: list[str]) -> DataFrame:
    have = [c for c in dict.fromkeys(columns) if c in df.columns and c != key]
    return first_rows(df.select(key, *have), key).select(F.col(key).alias(f"_key{suffix}"), *[F.col(c).alias(c + suffix if c in taken else c) for c in have])


def enrich(matches: DataFrame, df1: DataFrame, df2: DataFrame, id1: str, id2: str, config: ConsolidationConfig) -> DataFrame:
    """matches with metadata columns of both sides (suffixed where names clash) and `_priority`."""
    out = matches
    for df, key, on, columns, suffix in ((df1, id1, "df1_id", config.df1_metadata_columns, "_df1_meta"), (df2, id2, "df2_id", config.df2_metadata_columns, "_df2_meta")):
        if columns:
            side = _side(df, key, columns, suffix, out.columns)
            out = out.join(side, F.col(on) == F.col(f"_key{suffix}"), "left").drop(f"_key{suffix}")
    source, key, on = (df1, id1, "df1_id") if config.priority_column_source == "df1" else (df2, id2, "df2_id")
    if config.priority_column and config.priority_column in source.columns:
        side = first_rows(source.select(key, config.priority_column), key).select(F.col(key).alias("_pk"), F.col(config.priority_column).alias("_priority"))
        return out.join(side, F.col(on) == F.col("_pk"), "left").drop("_pk")
    return out.withColumn("_priority", F.lit(None).cast("string"))


def _main_rank(config: ConsolidationConfig, matches: DataFrame) -> DataFrame:
    """matches with `_rn`, 1 for the main match of its entity."""
    own = Window.partitionBy("df1_id")
    ties = [F.desc("similarity_score"), "df2_id"]
    if not (config.priority_column and config.priority_order):
        return matches.withColumn("_rn", F.row_number().over(own.orderBy(*ties)))
    ranks = {str(v): i for i, v in reversed(list(enumerate(config.priority_order)))}
    rank = F.coalesce(F.element_at(F.create_map(*[x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]), F.coalesce(F.col("_priority").cast("string"), F.lit("\0"))), F.lit(len(config.priority_order)))
    if config.priority_mode == "strict":
        return matches.withColumn("_rn", F.row_number().over(own.orderBy(rank, *ties)))
    if config.priority_mode == "threshold":
        near = F.max("similarity_score").over(own) - F.col("similarity_score") <= config.priority_threshold
        return matches.withColumn("_near", near).withColumn("_rn", F.row_number().over(own.orderBy(F.desc("_near"), rank, *ties))).drop("_near")
    raise ConfigurationError("priority_mode is strict or threshold", priority_mode=config.priority_mode)


def _frames(rows: pa.Table, starts: list[int]) -> Iterator[pd.DataFrame]:
    """rows from each of starts to the next as a frame of their own. All are converted at once, which costs far less than one by one,
    but for columns whose type in pandas hangs on which rows are converted together: those with nulls, and nested ones."""
    alone = [i for i, c in enumerate(rows.columns) if pa.types.is_nested(c.type) or c.null_count and (pa.types.is_integer(c.type) or pa.types.is_boolean(c.type))]
    frame = rows.to_pandas()
    for start, stop in zip(starts, starts[1:], strict=False):
        part = frame.iloc[start:stop].copy()
        part.index = pd.RangeIndex(stop - start)
        for i in alone:
            part.isetitem(i, rows.column(i).slice(start, stop - start).to_pandas())
        yield part


def _selected(pick: Callable[[pd.DataFrame], pd.Series]):
    """Adds _rn, 1 for the row that pick chooses of the rows of one df1_id. These come together; a task holds those of one
    id and of one batch."""

    def judged(rows: pa.Table, starts: list[int]) -> pa.Table:
        ranks: list[int] = []
        for part in _frames(rows, starts):
            chosen = pick(part).name
            ranks += [1 if i == chosen else 2 for i in range(len(part))]
        return rows.append_column("_rn", pa.array(ranks, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # of the last id so far, whose rows may go on

        def release() -> pa.Table:
            rows = pa.concat_tables(held)
            held.clear()
            return judged(rows, [0, rows.num_rows])

        for batch in batches:
            rows, done = pa.Table.from_batches([batch]), []
            ids = rows["df1_id"].to_pylist()
            if not ids:
                continue
            starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            if held and ids[0] == held[0]["df1_id"][0].as_py():
                held.append(rows.slice(0, starts[1]))
                starts = starts[1:]
            if len(starts) > 1:
                if held:
                    done.append(release())
                first, last = starts[0], starts[-2]
                if first < last:
                    done.append(judged(rows.slice(first, last - first), [i - first for i in starts[:-1]]))
                held.append(rows.slice(last))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from release().combine_chunks().to_batches()

    return run


def consolidate(matches: DataFrame, df1: DataFrame, df2: DataFrame, id1: str, id2: str, config: ConsolidationConfig, name2: str = "name") -> DataFrame:
    """One row per id of df1 (its first row) with main_<id2>, main_<name2>, main_similarity_score, main_<priority>,
    other_candidates, total_matches and all_match_ids; nulls and 0 where nothing matches. Ids are joined by ', '
    in order of score."""
    if not config.enabled:
        return df1
    rich = enrich(matches, df1, df2, id1, id2, config)
    if config.filter_function is not None:
        rule = config.filter_function
        rich = rich.where(rule() if callable(rule) and not isinstance(rule, Column) else rule)
    if config.selection_function is not None:
        together = spread(rich, "df1_id").sortWithinPartitions("df1_id")
        ranked = together.mapInArrow(_selected(config.selection_function), StructType([*rich.schema.fields, StructField("_rn", IntegerType())]))
    else:
        ranked = _main_rank(config, rich)
    entry = F.struct((-F.col("similarity_score")).alias("s"), F.col("df2_id").alias("id"), F.col("_rn").alias("rn"))
    per = ranked.groupBy("df1_id").agg(
        F.min(F.when(F.col("_rn") == 1, F.struct("df2_id", "df2_name", "similarity_score", "_priority"))).alias("m"), F.count("*").alias("total_matches"), F.sort_array(F.collect_list(entry)).alias("all")
    )
    ids = lambda a: F.nullif(F.array_join(F.transform(a, lambda x: x["id"].cast("string")), ", "), F.lit(""))
    columns = [F.col("m.df2_id").alias(f"main_{id2}"), F.col("m.df2_name").alias(f"main_{name2}"), F.col("m.similarity_score").alias("main_similarity_score")]
    if config.priority_column:
        columns.append(F.col("m._priority").alias(f"main_{config.priority_column}"))
    columns += [ids(F.filter("all", lambda x: x["rn"] != 1)).alias("other_candidates"), "total_matches"]
    if config.keep_all_matches:
        columns.append(ids(F.col("all")).alias("all_match_ids"))
    side = per.select(F.col("df1_id").alias("_of"), *columns)
    return first_rows(df1, id1).join(side, F.col(id1) == F.col("_of"), "left").drop("_of").fillna(0, ["total_matches"])
