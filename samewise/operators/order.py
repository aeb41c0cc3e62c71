"""Running sums over a whole table in a given order, without gathering it in one task; rows dealt to all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise.sources.shared import materialize

_PART = "_range_part"
_DEAL, _DEALS = "_deal", 1009


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to spark.sql.shuffle.partitions tasks. Adaptive execution merges partitions by their bytes; this
    keeps their number where few bytes mean much work, as rows that a join multiplies or that Python looks at."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def join_dealt(rows: DataFrame, facts: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined to facts. Rows of one value of key are dealt to many tasks, however many they are: only the distinct
    (value, deal) meet facts by the value alone, and what facts hold of a value goes along to each of its deals. rows
    are stored for that. A null key meets nothing."""
    stored = materialize(rows.withColumn(_DEAL, F.pmod(F.monotonically_increasing_id(), F.lit(_DEALS))), "dealt")
    met = stored.select(key, _DEAL).distinct().join(facts, key)
    return stored.join(met, [key, _DEAL], how).drop(_DEAL)


def _cumulate(n: int, keys: list[int | None]):
    """Adds to batches, whose last n columns are the values to sum, the sums of all rows of the task before each. The
    sum of value i starts anew where the column keys[i] changes, if that is given. Sums wrap around at 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, last = np.zeros(n, np.int64), [None] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for i in range(n):
                values = batch.column(batch.num_columns - n + i).to_numpy(zero_copy_only=False)
                upto = np.cumsum(values)
                before = upto - values
                if keys[i] is None:
                    out.append(before + carried[i])
                    carried[i] += upto[-1]
                    continue
                key = batch.column(keys[i]).to_numpy(zero_copy_only=False)
                anew = np.concatenate(([last[i] is None or key[0] != last[i]], key[1:] != key[:-1]))
                starts = np.nonzero(anew)[0]
                group = np.cumsum(anew)
                base = np.concatenate(([-carried[i]], before[starts]))[group]
                out.append(before - base)
                carried[i], last[i] = upto[-1] - base[-1], key[-1]
            columns = [*batch.columns, *[pa.array(x, pa.int64()) for x in out]]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *[f"_before{i}" for i in range(n)]])

    return run


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], within: dict[str, str] | None = None) -> DataFrame:
    """df with one more column (long) per entry of sums: the sum of its expression over all rows before, in `order`.

    A sum named in `within` starts anew with each value of the column given there, a long without nulls whose equal values
    are neighbours in `order`. Rows are dealt to tasks by ranges of `order`, sorted there and summed in the same pass; what
    ranges before bring along, one row per task, is then added. So no value of the order columns gathers more rows in
    a task than are equal in all of them, and the sum of 1 is a rank from 0. Among rows equal in all order columns the
    order is any.
    """
    within = within or {}
    voids = {c: df[c].cast("string") for c, t in df.dtypes if t == "void"}
    df = df.withColumns(voids) if voids else df
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    valued = dealt.select("*", F.spark_partition_id().alias(_PART), *[v.cast("long").alias(f"_value{i}") for i, v in enumerate(sums.values())])
    keys = [df.columns.index(within[k]) if k in within else None for k in sums]
    schema = T.StructType([*valued.schema.fields, *[T.StructField(f"_before{i}", T.LongType()) for i in range(len(sums))]])
    stored = materialize(valued.mapInArrow(_cumulate(len(sums), keys), schema), "ranges")
    out = {k: F.col(f"_before{i}") for i, k in enumerate(sums)}
    for key in {None, *within.values()}:
        mine = {k: i for i, k in enumerate(sums) if within.get(k) == key}
        if not mine:
            continue
        by = [_PART] if key is None else [_PART, key]
        totals = stored.groupBy(*by).agg(*[F.sum(f"_value{i}").alias(f"_sum{i}") for i in mine.values()])
        # a row per task of the step above; with a key, of those tasks only whose first key began in a task before
        ahead = (Window.orderBy(_PART) if key is None else Window.partitionBy(key).orderBy(_PART)).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.select(*by, *[F.sum(f"_sum{i}").over(ahead).alias(f"_ahead{i}") for i in mine.values()]).where(F.col(f"_ahead{next(iter(mine.values()))}").isNotNull())
        stored = stored.join(F.broadcast(offsets), by, "left")
        out |= {k: F.col(f"_before{i}") + F.coalesce(f"_ahead{i}", F.lit(0)) for k, i in mine.items()}
    return stored.select(*[F.col(f"`{c}`") for c in df.columns], *[v.alias(k) for k, v in out.items()])
