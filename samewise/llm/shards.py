"""Shards of near equal bytes, tokens and rows by vector bin packing.

Documents of equal text are a group. A group is a vector: its bytes, its tokens (words) and its rows, each as a share of
what one of `shards` equal shards holds. Groups are placed from the longest vector down, each in the shard where the
dot product of its vector with the shard's residual capacity is highest (ties: the lower number), which is the
choice that lowers the sum of squared residuals most. A group that exceeds a whole shard in some measure cannot go
into one and is cut into equal pieces of at most PIECE of a shard, placed like groups; all others stay together.

Groups of at least HEAVY of a shard in some measure are at most 3 x shards / HEAVY (as their shares add up to
3 x shards), pieces included, whatever the number of documents: these are placed first, in the driver. All others are
dealt by a hash to tasks of about PER_TASK groups; a task fills its part of what capacity is left, in each measure as
its groups' share of all the small ones. Every task ends with its smallest groups, so it misses its part by about one of
those in each shard.

Slots number a shard's rows from 0 in the order of groups and then of doc_id. Ranks are running sums over ranges of an
order, and rows of heavy groups meet a broadcast table of these, so no task gets a whole group of many copies.

Edge cases: null text counts as the empty one; null doc_ids come first in their group; repeated rows are rows; a very
long text is one row that may exceed a shard by itself; equal texts are told by 64-bit and 32-bit hashes and length; other
columns are ignored; an empty table gives an empty result, and fewer rows than shards leave shards empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.text import count_words
from samewise.operators.order import running
from samewise.sources.shared import materialize

SHARDS, OVERHEAD = 40, 16
HEAVY, PIECE, PER_TASK = 1 / 32, 1 / 8, 1 << 15
#: How much a residual of bytes, tokens and rows counts. The law of the result is equal bytes.
WEIGHTS = (4.0, 1.0, 1.0)
_KEY = ["mark", "text_crc32", "size"]


@dataclass(frozen=True)
class Totals:
    size: int
    tokens: int
    rows: int
    shards: int

    def share(self, n_size, n_tokens, n_rows) -> tuple:
        """Bytes, tokens and rows in units of one shard's capacity."""
        return n_size * self.shards / max(self.size, 1), n_tokens * self.shards / max(self.tokens, 1), n_rows * self.shards / max(self.rows, 1)


def pack(vectors: np.ndarray, keys: list, residual: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> np.ndarray:
    """The shard of each vector (one row per group, in shares of a shard). residual(shards, 3) is lowered by what is placed.

    Groups go in the order of their squared lengths, then of keys.
    """
    w = np.array(weights)
    length = (w * vectors * vectors).sum(axis=1)
    shard = np.zeros(len(vectors), np.int32)
    for n in sorted(range(len(vectors)), key=lambda n: (-length[n], keys[n])):
        a, b, c = (w * vectors[n]).tolist()
        at = int(np.argmax(a * residual[:, 0] + b * residual[:, 1] + c * residual[:, 2]))
        residual[at] -= vectors[n]
        shard[n] = at
    return shard


def _measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with at, the rank in the order of groups and doc_id; stored without texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), count_words(text).alias("tokens"), F.xxhash64(text).alias("mark"))
    return materialize(running(rows, [F.col(c) for c in (*_KEY, "doc_id")], {"at": F.lit(1)}), "rows")


def _small_tasks(left: np.ndarray, totals: Totals, small: list[int]):
    """Places one task's groups; `left` is the residual capacity, `small` the bytes, tokens and rows of all small groups."""

    def run(key: tuple, groups: pd.DataFrame) -> pd.DataFrame:
        sums = [groups["n"] * groups["size"], groups["n"] * groups["tokens"], groups["n"]]
        vectors = np.stack([np.asarray(x, np.float64) for x in totals.share(*sums)], axis=1)
        part = np.array([int(x.sum()) / max(y, 1) for x, y in zip(sums, small, strict=True)])
        groups["shard"] = pack(vectors, list(groups[_KEY].itertuples(index=False, name=None)), left * part)
        return groups[[*_KEY, "first", "n", "shard"]]

    return run


def place(docs: DataFrame, shards: int = SHARDS, per_task: int = PER_TASK) -> DataFrame:
    """Rows (doc_id, size, text_crc32, tokens, shard, slot), one per row of docs(doc_id, text)."""
    rows = _measured(docs)
    spark = docs.sparkSession
    groups = materialize(rows.groupBy(*_KEY).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.max("tokens").alias("tokens")), "groups")
    measures = F.col("n") * F.col("size"), F.col("n") * F.col("tokens"), F.col("n")
    # whole numbers, so that reruns agree whatever the order of sums
    sums = lambda df: [int(x or 0) for x in df.agg(*map(F.sum, measures)).first()]
    totals = Totals(*sums(groups), shards)
    most = F.greatest(*totals.share(*measures)).cast("double")
    # bounded by 3 x shards / HEAVY rows
    heavy = groups.where(most >= HEAVY).withColumn("most", most).orderBy(*_KEY).collect()
    left = np.ones((shards, 3))
    cut, pieces = [], []
    for g in heavy:
        per = g.n if g.most <= 1 else max(1, int(g.n * PIECE / g.most))
        cut.append((g.mark, g.text_crc32, g.size, g.first, per))
        pieces += [(g.mark, g.text_crc32, g.size, p, g.first + p * per, min(per, g.n - p * per), g.tokens) for p in range(-(-g.n // per))]
    vectors = np.array([totals.share(p[5] * p[2], p[5] * p[6], p[5]) for p in pieces], np.float64).reshape(-1, 3)
    found = pack(vectors, [p[:4] for p in pieces], left)
    placed = [(*p[:3], p[3], p[4], p[5], int(s)) for p, s in zip(pieces, found, strict=True)]
    large = spark.createDataFrame(placed, "mark long, text_crc32 long, size long, piece int, first long, n long, shard int")

    light = groups.where(most < HEAVY)
    tasks = max(1, -(-light.count() // per_task))
    dealt = light.withColumn("deal", F.pmod(F.xxhash64(*_KEY), F.lit(tasks)))
    packed = dealt.groupBy("deal").applyInPandas(_small_tasks(left, totals, sums(light)), "mark long, text_crc32 long, size long, first long, n long, shard int")
    every = materialize(packed.select(*_KEY, F.lit(0).alias("piece"), "first", "n", "shard").union(large.select(*_KEY, "piece", "first", "n", "shard")), "placed")
    ranked = running(every, [F.col("shard"), F.col("first")], {"before": F.col("n")})
    # one row per shard
    starts = ranked.groupBy("shard").agg(F.min("before").alias("start"))
    slots = materialize(ranked.join(F.broadcast(starts), "shard").withColumn("offset", F.col("before") - F.col("start")), "slots")

    bounds = F.broadcast(spark.createDataFrame(cut, "mark long, text_crc32 long, size long, whole long, per long"))
    told = rows.join(bounds, _KEY, "left")
    many = told.where("per is not null").withColumn("piece", F.floor((F.col("at") - F.col("whole")) / F.col("per")).cast("int"))
    pieced = slots.join(F.broadcast(large.select(*_KEY).distinct()), _KEY, "left_semi").select(*_KEY, "piece", "first", "shard", "offset")
    few = slots.join(F.broadcast(large.select(*_KEY).distinct()), _KEY, "left_anti").select(*_KEY, "first", "shard", "offset")
    columns = ["doc_id", "size", "text_crc32", "tokens", "shard", (F.col("offset") + F.col("at") - F.col("first")).alias("slot")]
    with_heavy = many.join(F.broadcast(pieced), [*_KEY, "piece"]).select(*columns)
    return told.where("per is null").join(few, _KEY).select(*columns).union(with_heavy)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Write docs(doc_id, text) as one folder `shard=n` per shard under path, with size, tokens and slot, and read them back.

    A folder holds one file per task; within a folder, slot tells the order. Rows meet their places by doc_id and the
    text's hashes; rows that are equal in all of these take their slots in any order.
    """
    placed = place(docs.select("doc_id", "text"), shards)
    copies = lambda df: running(df, [F.col("text_crc32"), F.col("size"), F.col("doc_id")], {"nth": F.lit(1)})
    text = F.coalesce("text", F.lit(""))
    told = docs.select("doc_id", "text", (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # equal (doc_id, hashes) are numbered on either side, so that repeated rows meet one to one
    a, b = materialize(copies(told), "told").alias("a"), materialize(copies(placed), "numbered").alias("b")
    joined = a.join(b, "nth").select("a.doc_id", "a.text", "b.size", "b.tokens", "b.slot", "b.shard")
    joined.write.partitionBy("shard").mode("errorifexists").parquet(path)
    return docs.sparkSession.read.parquet(path)
