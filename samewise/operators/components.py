"""Connected components of an edge table, as rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.sources.shared import discard, materialize, new_path


def _star(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step: every node hands its neighbours on to its least neighbour.

    keep_larger takes only the larger neighbours (large star), otherwise only the smaller ones (small star).
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if keep_larger:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if keep_larger:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node of an edge, component being the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the edge set no longer
    changes: then every node points at the least node of its component. Rounds grow with the logarithm
    of the longest path. The edges are computed once; each round is written to the shared folder and the round before it
    emptied then. Only counts and sums reach the driver.
    Self loops give a node its own component; null ends are ignored. Raises RuntimeError if max_rounds
    do not suffice, rather than returning unfinished components.
    """
    named = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    every = materialize(named.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = every.select(F.col("a").alias("node")).union(every.select(F.col("b").alias("node")))
    now, old = every.where("a <> b"), None

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = mark(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        path = new_path(edges.sparkSession, "cc")
        now = materialize(_star(_star(now, True), False), "cc", path)
        if old:
            discard(edges.sparkSession, old)
        old = path
        if (after := mark(now)) == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.distinct().join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
