"""The greedy degree cap, as rounds of windows and of pointer jumping along chains of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.sources.shared import materialize

#: So few open pairs are scanned in order by one task; chains are followed after rounds that took less than this share.
FINISH, SLOW = 20_000, 0.25


def _scan(k: int):
    """Takes the open pairs (_n, _a, _b, _ua, _ub) of one task in order; _ua and _ub are the places taken before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used: dict[str, int] = {}
        for frame in batches:
            taken = []
            for n, a, b, ua, ub in frame[["_n", "_a", "_b", "_ua", "_ub"]].itertuples(index=False):
                x, y = used.get(a, ua), used.get(b, ub)
                if x < k and y < k:
                    used[a] = x + 1
                    used[b] = used.get(b, ub) + 1
                    taken.append(n)
            yield pd.DataFrame({"_n": pd.Series(taken, dtype="int64")})

    return run


def _chained(marked: DataFrame, k: int) -> DataFrame:
    """Rows (_n, _take): open pairs of a round that hang on one of its accepted pairs by a chain.

    A pair is linked to another if that is the only open one before it at an end that one more pair fills, and its
    other end is free whatever comes or hangs on the same pair: it is accepted exactly if that one is not. Every step
    lets all pairs look twice as far along their links, so a chain of n pairs takes log n steps.
    """
    blocked = {s: F.col(f"_r{s}") + F.col(f"_u{s}") > k for s in "ab"}
    alone = {s: (F.col(f"_r{s}") == 2) & (F.col(f"_u{s}") == k - 1) for s in "ab"}
    to = F.when(~blocked["b"] & alone["a"], F.col("_pa")).when(~blocked["a"] & alone["b"], F.col("_pb")).when(alone["a"] & alone["b"] & (F.col("_pa") == F.col("_pb")), F.col("_pa"))
    links = materialize(marked.where("not _take").select("_n", to.alias("_to"), F.lit(1).alias("_odd")).where("_to is not null"), "links")
    while True:
        further = links.select(F.col("_n").alias("_to"), F.col("_to").alias("_far"), F.col("_odd").alias("_more"))
        met = materialize(links.join(further, "_to", "left"), "reach")
        links = met.select("_n", F.coalesce("_far", "_to").alias("_to"), F.col("_odd").bitwiseXOR(F.coalesce("_more", F.lit(0))).alias("_odd"))
        if met.where("_far is not null").isEmpty():
            break
    ends = marked.where("_take").select(F.col("_n").alias("_to"))
    return links.join(ends, "_to", "left_semi").select("_n", (F.col("_odd") == 0).alias("_take"))


def degree_cap(pairs: DataFrame, k: int, left: list[str | Column], right: list[str | Column], order: Column, two_sided: bool = False, finish: int = FINISH) -> DataFrame:
    """The pairs that a scan in `order` would accept if it took a pair exactly while both its ends have fewer than k.

    Each round ranks the open pairs at both ends: those within the free places of both are what the scan
    takes next whatever comes later, so they are accepted; ends that are full drop their open pairs. The first open
    pair is always decided, so the rounds end; a few usually do. Where a round decides little, pairs that wait in chains for
    one another are decided by pointer jumping. Once at most `finish` pairs are open, one task scans
    them. With two_sided the ends of either side are counted apart, else equal values on both sides are one end. Pairs that
    are equal in order are taken in any order; null ends are ends of their own.
    """
    def end(columns: list[str | Column], side: str) -> Column:
        cols = [F.col(c) if isinstance(c, str) else c for c in columns]
        return F.concat_ws("\x1f", F.lit(side if two_sided else ""), *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols])

    named = pairs.withColumn("_a", end(left, "1")).withColumn("_b", end(right, "2")).withColumn("_o", order).withColumn("_n", F.monotonically_increasing_id())
    every = materialize(named, "pairs")
    todo = every.select("_n", "_a", "_b", "_o", F.lit(0).cast("long").alias("_ua"), F.lit(0).cast("long").alias("_ub"))
    taken = []
    while n := todo.count():
        if n <= finish:
            # one task: the rows of a bounded rest
            rest = todo.orderBy("_o", "_n").coalesce(1)
            taken.append(materialize(rest.mapInPandas(_scan(k), "_n long"), "taken"))
            break
        live = todo.where((F.col("_ua") < k) & (F.col("_ub") < k))
        both = live.select("_n", "_o", F.col("_a").alias("end")).union(live.where("_a <> _b").select("_n", "_o", F.col("_b").alias("end")))
        at_end = Window.partitionBy("end").orderBy("_o", "_n")
        ranked = both.withColumn("rank", F.row_number().over(at_end)).withColumn("before", F.lag("_n").over(at_end))
        # a pair whose ends are one end takes two of its places when it is accepted, but needs one
        a = ranked.select("_n", F.col("end").alias("_a"), F.col("rank").alias("_ra"), F.col("before").alias("_pa"))
        b = ranked.select("_n", F.col("end").alias("_b"), F.col("rank").alias("_rb"), F.col("before").alias("_pb"))
        fits = (F.col("_ra") + F.col("_ua") <= k) & (F.col("_rb") + F.col("_ub") <= k)
        marked = materialize(live.join(a, ["_n", "_a"]).join(b, ["_n", "_b"]).withColumn("_take", fits), "round")
        rest = marked.where("not _take")
        took = marked.where("_take")
        if took.count() < SLOW * n and marked.where("_a = _b").isEmpty():
            decided = materialize(_chained(marked, k), "chained")
            took = took.select("_n", "_a", "_b").union(marked.join(decided.where("_take"), "_n", "left_semi").select("_n", "_a", "_b"))
            rest = rest.join(decided, "_n", "left_anti")
        taken.append(took.select("_n"))
        gained = took.select(F.col("_a").alias("end")).union(took.select(F.col("_b").alias("end"))).groupBy("end").agg(F.count("*").alias("gain"))
        for side in ("_a", "_b"):
            more = gained.select(F.col("end").alias(side), F.col("gain").alias(f"{side}_gain"))
            rest = rest.join(more, side, "left").withColumn(f"_u{side[1]}", F.col(f"_u{side[1]}") + F.coalesce(f"{side}_gain", F.lit(0)))
        todo = materialize(rest.where((F.col("_ua") < k) & (F.col("_ub") < k)).select("_n", "_a", "_b", "_o", "_ua", "_ub"), "open")
    if not taken:
        return pairs.limit(0)
    chosen = taken[0]
    for t in taken[1:]:
        chosen = chosen.union(t)
    return every.join(chosen, "_n", "left_semi").select(*pairs.columns)
