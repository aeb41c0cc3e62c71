"""Pairs of names within a number of insertions and deletions, by an inverted index of segments.

A text of length l is cut into D(l) + 1 segments of near equal length, D(l) being the most insertions and deletions that
the cutoff allows it with any text at least as long. Each of these breaks at most one segment, so one is left intact
in the other text, shifted by no more than the changes before it and after it allow (Li, Deng, Wang and Feng, 2011).
Texts are indexed by (l, number of the segment, segment) and looked up by the substrings of texts of length l and
more at these places; equal keys are joined, candidates are held against the parity of their characters' counts (a
change alters one), made distinct and compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.functions.tiles import _norm, lcs_pairs
from samewise.operators.grid import PAIRS, scored
from samewise.operators.order import running, spread
from samewise.sources.shared import materialize

#: Of so many texts one is taken to estimate the number of candidates; frequent segments are frequent among these too.
SAMPLE = 16
_EPS = 1e-9


def _longest(length: int, cutoff: float) -> int:
    """Of the longest text that reaches the cutoff with one of that length."""
    return int(length * (200 - cutoff) / cutoff + _EPS)


def changes(length: int, cutoff: float) -> int:
    """D(length)."""
    return int((1 - cutoff / 100) * (length + _longest(length, cutoff)) + _EPS)


def applies(lengths: list[int], cutoff: float) -> bool:
    """Whether texts of all these lengths can be cut into as many segments as it takes."""
    return 0 < cutoff <= 100 and all(changes(n, cutoff) < n for n in lengths)


def _cut(length: Column, n: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of n; the last ones are longer by one."""
    base = F.floor(length / n)
    short = n - (length - base * n)
    return i * base + F.greatest(i - short, F.lit(0)), base + F.when(i >= short, 1).otherwise(0)


def _keys(texts: DataFrame, cutoff: float, lengths: list[int], index: bool) -> DataFrame:
    """texts(at, text, length, odd) by key. lengths: those that the table has, each with its number of segments."""
    segments = F.create_map(*[F.lit(x) for n in lengths or [1] for x in (n, changes(n, cutoff) + 1)])
    m = F.col("length")

    def key(length: Column, i: Column, start: Column, size: Column) -> Column:
        return F.xxhash64(length.cast("long"), i.cast("long"), F.substr(F.col("text"), (start + 1).cast("int"), size.cast("int")))

    def own(i: Column) -> Column:
        start, size = _cut(m, segments[m], i)
        return key(m, i, start, size)

    def looked_up(length: Column) -> Column:
        n, more = segments[length], m - length

        def at(i: Column) -> Column:
            start, size = _cut(length, n, i)
            # as many changes before the segment as there are segments before it, and as many after as after it
            low = F.greatest(-i, more - (n - 1 - i), -start)
            high = F.least(i, more + (n - 1 - i), m - size - start)
            return F.when(low <= high, F.transform(F.sequence(low, high), lambda s: key(length, i, start + s, size))).otherwise(F.array().cast("array<long>"))

        return F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), at))

    if index:
        keys = F.transform(F.sequence(F.lit(0), segments[m] - 1), own)
    else:
        here = F.filter(F.array(*map(F.lit, lengths or [1])), lambda x: (x <= m) & (x * (200 - cutoff) / cutoff + _EPS >= m))
        keys = F.flatten(F.transform(here, looked_up))
    return texts.select("at", "length", "odd", F.explode(F.array_distinct(keys)).alias("key"))


def _parity(text: Column) -> Column:
    """64 bits: by class of characters whether their number is odd."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.ascii(c), F.lit(64))))))


def numbered(names: DataFrame) -> DataFrame:
    """names(name, text) with at, length and odd; stored."""
    ranked = running(names, [F.col("text"), F.col("name")], {"at": F.lit(1)})
    return materialize(ranked.withColumn("length", F.length("text")).withColumn("odd", _parity(F.col("text"))), "texts")


class SegmentJoin:
    """The join of left with right, or of left with itself; tables hold name and text, each name once."""

    def __init__(self, left: DataFrame, right: DataFrame | None, cutoff: float) -> None:
        self.cutoff, self.alone = cutoff, right is None
        self.left = numbered(left)
        self.right = self.left if right is None else numbered(right)
        histogram = lambda t: {r.length: r["count"] for r in t.groupBy("length").count().collect()}  # noqa: E731  a row per length
        self.lengths_a = histogram(self.left)
        self.lengths_b = self.lengths_a if right is None else histogram(self.right)

    def pairs_in_reach(self) -> int:
        """Pairs whose lengths allow the cutoff: what a comparison of all pairs has to look at."""
        least = self.cutoff / (200 - self.cutoff)
        n = sum(x * y for a, x in self.lengths_a.items() for b, y in self.lengths_b.items() if min(a, b) >= least * max(a, b) - _EPS)
        return n // 2 if self.alone else n

    def applies(self) -> bool:
        return applies([*self.lengths_a, *self.lengths_b], self.cutoff)

    def _sides(self) -> list[tuple[DataFrame, DataFrame, bool]]:
        """(index, look-ups, whether the index is of the left table): the shorter text of a pair is the indexed one."""
        a, b = sorted(self.lengths_a), sorted(self.lengths_b)
        out = [(_keys(self.left, self.cutoff, a, True), _keys(self.right, self.cutoff, a, False), True)]
        return out if self.alone else [*out, (_keys(self.right, self.cutoff, b, True), _keys(self.left, self.cutoff, b, False), False)]

    def estimate(self) -> int:
        """About how many rows the join of keys has, from one text in SAMPLE of either side. Only the choice of method
        depends on it, never the pairs."""
        part = F.pmod(F.xxhash64("at"), F.lit(SAMPLE)) == 0
        total = 0
        for index, lookups, _ in self._sides():
            a, b = (t.where(part).groupBy("key").agg(F.count("*").alias(n)) for t, n in ((index, "n"), (lookups, "m")))
            met = F.col("n").cast("double") * (F.col("m") - (F.lit(1) if self.alone else F.lit(0)))  # a text meets itself
            total += SAMPLE**2 * int(a.join(b, "key").agg(F.sum(met)).first()[0] or 0)
        return total

    def pairs(self, threshold: float, multiplier: float) -> DataFrame:
        """Rows (name_a, name_b, similarity_score) as of operators.grid."""
        found = None
        for index, lookups, of_left in self._sides():
            x, y = (c.withColumnsRenamed({"at": f"at_{s}", "length": f"length_{s}", "odd": f"odd_{s}"}) for c, s in ((index, "i"), (lookups, "l")))
            most = (1 - self.cutoff / 100) * (F.col("length_i") + F.col("length_l")) + _EPS
            met = x.join(y, "key").where(F.bit_count(F.col("odd_i").bitwiseXOR(F.col("odd_l"))) <= most)
            i, j = ("at_i", "at_l") if of_left else ("at_l", "at_i")
            if self.alone:
                met = met.where("at_i <> at_l").select(F.least("at_i", "at_l").alias("a"), F.greatest("at_i", "at_l").alias("b"))
            else:
                met = met.select(F.col(i).alias("a"), F.col(j).alias("b"))
            found = met if found is None else found.union(met)
        texts = lambda t, s: t.select(F.col("at").alias(s), F.col("name").alias(f"name_{s}"), F.col("text").alias(f"text_{s}"))
        work = found.distinct().join(texts(self.left, "a"), "a").join(texts(self.right, "b"), "b").select("name_a", "name_b", "text_a", "text_b")
        cutoff = self.cutoff

        def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                a, b = rows["text_a"].tolist(), rows["text_b"].tolist()
                every = rows.reset_index().index.to_numpy()
                n = rows["text_a"].str.len().to_numpy() + rows["text_b"].str.len().to_numpy()
                raw = _norm(n - 2 * lcs_pairs(a, b, every, every), n)
                ok = raw >= cutoff
                yield scored(rows["name_a"].to_numpy(object)[ok], rows["name_b"].to_numpy(object)[ok], raw[ok], threshold, multiplier)

        return spread(work).mapInPandas(verify, PAIRS)
