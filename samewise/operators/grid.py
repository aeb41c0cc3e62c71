"""All pairs of two tables of names that can reach a score, by a grid of tiles.

Names are ranked by the length of the text that is scored and cut into tiles of equal numbers of names. Tile i of the left
and tile j of the right table meet in cell (i, j) if their lengths can reach the cutoff, so with g tiles a name goes to at
most g cells, about the square root of twice their number in a self-join. A cell is a task's group of at most two tiles.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.functions.tiles import least_share, score_tiles
from samewise.operators.order import running
from samewise.sources.shared import materialize

PAIRS = "name_a string, name_b string, similarity_score double"
#: Least number of names in a tile, so that few names make few tasks.
_FEW = 64


def tiled(names: DataFrame, size: int) -> DataFrame:
    """names(name, text) with length and tile; stored."""
    ranked = running(names.withColumn("length", F.length("text")), [F.col("length"), F.col("name")], {"at": F.lit(1)})
    return materialize(ranked.select("name", "text", "length", F.floor(F.col("at") / size).alias("tile")), "tiles")


def _lengths(tiles: DataFrame) -> list[tuple[int, int]]:
    """Least and greatest length by tile: one row per `size` names."""
    return [(r.low, r.high) for r in tiles.groupBy("tile").agg(F.min("length").alias("low"), F.max("length").alias("high")).orderBy("tile").collect()]


def _reach(mine: list[tuple[int, int]], others: list[tuple[int, int]], least: float) -> list[tuple[int, int]]:
    """By tile of `mine` the first and last tile of `others` (sorted by length as well) whose lengths can reach it."""
    lows, highs = [low for low, _ in others], [high for _, high in others]
    out = []
    for low, high in mine:
        first = bisect_left(highs, low * least - 1e-6)
        last = bisect_right(lows, high / least + 1e-6) - 1 if least else len(others) - 1
        out.append((first, last))
    return out


def _score(scorer: str, threshold: float, cutoff: float, multiplier: float, self_join: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "length"], kind="stable")
        a = rows[rows["side"] == 0]
        alone = self_join and key[0] == key[1]
        b = a if alone else rows[rows["side"] == 1]
        i, j, raw = score_tiles(scorer, a["text"].tolist(), b["text"].tolist(), cutoff, alone)
        return scored(a["name"].to_numpy(object)[i], b["name"].to_numpy(object)[j], raw, threshold, multiplier)

    return run


def scored(names_a: np.ndarray, names_b: np.ndarray, raw: np.ndarray, threshold: float, multiplier: float) -> pd.DataFrame:
    """The pairs that satisfy the predicate: the score's float32 is not 0 and reaches the threshold when multiplied."""
    got = raw.astype(np.float32).astype(np.float64)
    kept = (got != 0) & (got * multiplier >= threshold)
    return pd.DataFrame({"name_a": names_a[kept], "name_b": names_b[kept], "similarity_score": got[kept] * multiplier})


def grid_pairs(left: DataFrame, right: DataFrame | None, scorer: str, threshold: float, cutoff: float, multiplier: float, tile: int, tasks: int | None = None) -> DataFrame:
    """Rows (name_a, name_b, similarity_score) of the distinct rows of left(name, text) and right; without right each
    pair of left comes once."""
    spark = left.sparkSession
    parallel = tasks or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = [left.count()] + ([right.count()] if right is not None else [])
    # cells for a few rounds of tasks, tiles of `tile` names at most
    across = max(1, round((4 * parallel) ** 0.5))
    sizes = [min(tile, max(_FEW, -(-n // across))) for n in counts]
    a = tiled(left, sizes[0])
    b = a if right is None else tiled(right, sizes[1])
    mine, least = _lengths(a), least_share(scorer, cutoff)
    others = mine if right is None else _lengths(b)
    ahead = [(max(first, i) if right is None else first, last) for i, (first, last) in enumerate(_reach(mine, others, least))]
    back = [(0, -1)] * len(others)
    for i, (first, last) in enumerate(ahead):
        for j in (range(first, last + 1)):
            back[j] = (back[j][0] if back[j][1] >= 0 else i, i)
    if right is None:  # a tile meets itself as left alone
        back = [(first, min(last, j - 1)) for j, (first, last) in enumerate(back)]
    cells = sum(max(0, last - first + 1) for first, last in ahead)

    def sent(tiles: DataFrame, reach: list[tuple[int, int]], side: int) -> DataFrame:
        bounds = spark.createDataFrame([(n, *r) for n, r in enumerate(reach) if r[0] <= r[1]], "tile long, first long, last long")
        other = F.explode(F.sequence("first", "last"))
        i, j = ("tile", "other") if side == 0 else ("other", "tile")
        met = tiles.join(bounds, "tile").withColumn("other", other)
        return met.select(F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "length", "name", "text")

    rows = sent(a, ahead, 0).union(sent(b, back, 1))
    dealt = rows.repartition(tasks or max(1, min(4 * cells, 16 * parallel)), "i", "j")
    return dealt.groupBy("i", "j").applyInPandas(_score(scorer, threshold, cutoff, multiplier, right is None), PAIRS)
