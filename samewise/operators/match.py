"""Fuzzy matching: similarity joins of one or two name tables.

Names are normalised and equal ones collapsed, so the work is on distinct strings. Two ways lead to the same pairs. A grid
of tiles (samewise.operators.grid) brings together all names whose lengths can reach the threshold, and arrays of bounds
drop most pairs. For ratio and token_sort_ratio an inverted index of segments (samewise.operators.segments) finds
candidates by equality; it is taken where many pairs are in reach and the index promises few candidates.

The pair predicate: raw score >= threshold, its float32 not 0, and float32 x multiplier >= threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from samewise.errors import ConfigurationError, DataValidationError
from samewise.functions import normalize as N
from samewise.functions import scorers as S
from samewise.operators.cap import degree_cap
from samewise.operators.grid import grid_pairs
from samewise.operators.order import join_dealt, running, spread
from samewise.operators.segments import SegmentJoin
from samewise.sources.shared import materialize, materialize_counted

#: Most names in a tile.
TILE = 16_384
#: Rows of a name in one deal; a name of more rows is cut into several, about equal ones.
DEAL = 512
#: Within a table a row goes to about so many cells of deals, at most; where rows reach more others, deals are larger than DEAL.
CELLS = 48
#: The index of segments is asked from so many pairs in reach on, and taken if it has so many times fewer candidates.
MANY, GAIN = 4_000_000_000, 20


@dataclass
class NameClasses:
    """A match as classes of rows with one name. rows(id, raw, name, at) in the order `at` of a table's rows, links(name_a,
    name_b, similarity_score) of different names (within a table each two once), and the score of rows of one name, None
    if it is too low. Between two tables rows are of the left and others of the right one."""

    rows: DataFrame
    links: DataFrame
    same: float | None = None
    others: DataFrame | None = None

    def edges(self) -> DataFrame:
        """Links within a table in both directions, and names linked to themselves."""
        both = self.links.union(self.links.select(F.col("name_b"), F.col("name_a"), "similarity_score"))
        if self.same is None:
            return both
        own = self.rows.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
        return both.union(own.select("name", F.col("name").alias("b"), F.lit(self.same)))

    def count(self) -> int:
        """How many pairs of rows the links mean."""
        sizes = self.rows.groupBy("name").agg(F.count("*").alias("n"))
        right = sizes if self.others is None else self.others.groupBy("name").agg(F.count("*").alias("n"))
        a, b = (t.select(F.col("name").alias(f"name_{x}"), F.col("n").alias(f"n_{x}")) for t, x in ((sizes, "a"), (right, "b")))
        met = self.links.join(a, "name_a").join(b, "name_b").select((F.col("n_a") * F.col("n_b")).alias("n"))
        if self.others is None and self.same is not None:
            met = met.union(sizes.select(F.expr("n * (n - 1) div 2")))
        return met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n

    def expand(self, facts: DataFrame | None = None) -> DataFrame:
        """All pairs (id1, id2, name1, name2, similarity_score, at1, at2) within a table, the row of lesser `at` first. facts(_id,
        ...), one row per id, are joined to the rows before: their columns come as <column>_1 and <column>_2."""
        rows, more = self.rows, [c for c in facts.columns if c != "_id"] if facts is not None else []
        own = {c: f"_of_{c}" for c in more}
        if more:
            rows = rows.join(facts.withColumnsRenamed(own), F.col("id") == F.col("_id"), "left").drop("_id")
        pairs = expand_classes(rows, "name", materialize(self.edges(), "names"), list(own.values()))
        return pairs.withColumnsRenamed({f"{v}_{n}": f"{k}_{n}" for k, v in own.items() for n in (1, 2)})


@dataclass
class MatchResult:
    """pairs and facts about the run. Pairs given as a function are expanded when first asked for. metadata tells from the beginning how many entities took part (total_entities, or
    df1_entities and df2_entities: rows with a name; with several name columns all rows), as the jobs that prepared
    them observed it, and from stored() on how many pairs there are. Too few entities for a pair leave a message."""

    _pairs: DataFrame | Callable[[], DataFrame]
    metadata: dict = field(default_factory=dict)
    #: What pairs expands: linked names and their rows; none with a degree cap or several name columns.
    classes: NameClasses | None = None

    @cached_property
    def pairs(self) -> DataFrame:
        return self._pairs() if callable(self._pairs) else self._pairs

    @property
    def _found(self) -> str:
        return "matches_found" if "total_entities" in self.metadata else "cross_matches_found"

    def stored(self, path: str | None = None) -> MatchResult:
        """The same result with its pairs written (to path, else to the shared folder), and counted by the job that writes
        them: matches_found, or cross_matches_found between two tables."""
        pairs, seen = materialize_counted(self.pairs, "pairs", {self._found: F.count(F.lit(1))}, path)
        return MatchResult(pairs, {**self.metadata, **seen}, self.classes)

    def count(self) -> int:
        """How many pairs there are; from the numbers of rows by name where there are classes, without expanding them."""
        if self._found in self.metadata:
            return self.metadata[self._found]
        return self.pairs.count() if self.classes is None else self.classes.count()

    def counted(self) -> MatchResult:
        """The same result with its pairs counted into metadata as stored() does, but not written."""
        return MatchResult(self._pairs, {**self.metadata, self._found: self.count()}, self.classes)

    def counts(self) -> DataFrame:
        """One row: entities (total_entities, or df1_entities and df2_entities) and matches_found."""
        row = {k: v for k, v in self.metadata.items() if k in ("total_entities", "df1_entities", "df2_entities")}
        row["matches_found"] = self.count()
        spark = (self.pairs if self.classes is None else self.classes.rows).sparkSession
        return spark.createDataFrame([row], ", ".join(f"{k} long" for k in row))


def name_pairs(left: DataFrame, right: DataFrame | None, scorer: str, threshold: float, multiplier: float = 1.0, scale_cutoff: bool = False, method: str = "auto", tile: int | None = None, tasks: int | None = None) -> DataFrame:
    """Rows (name_a, name_b, similarity_score) of distinct normalised names that satisfy the predicate.

    left and right hold a column `name`; without right each unordered pair of different names of left comes
    once. With scale_cutoff the raw score is held against threshold / multiplier. method is grid, segments (ratio and
    token_sort_ratio with a cutoff that leaves every text a character per segment) or auto; the pairs are the same.
    """
    S.scorer(scorer)
    if method not in ("auto", "grid", "segments"):
        raise ConfigurationError("method is auto, grid or segments", method=method)
    cutoff = threshold / multiplier if scale_cutoff else threshold
    text = N.sorted_tokens(F.col("name")) if scorer == "token_sort_ratio" else F.col("name")
    a, b = (None if df is None else materialize(df.select("name").distinct().select("name", text.alias("text")), "distinct") for df in (left, right))
    indel = scorer in ("ratio", "token_sort_ratio") and 0 < cutoff <= 100
    if method == "segments" or method == "auto" and indel and (n := a.count()) * (n / 2 if b is None else b.count()) >= MANY:
        join = SegmentJoin(a, b, cutoff) if indel else None
        if join is None or not join.applies():
            if method == "segments":
                raise ConfigurationError("texts cannot be cut into as many segments as the threshold allows changes", scorer=scorer, cutoff=cutoff)
        elif method == "segments" or (reach := join.pairs_in_reach()) >= MANY and join.estimate() * GAIN <= reach:
            return join.pairs(threshold, multiplier)
    return grid_pairs(a, b, scorer, threshold, cutoff, multiplier, tile or TILE, tasks)


def _has(df: DataFrame, *columns: str) -> None:
    """Raise unless each of these names one column of df; names that differ by case only are one to Spark by default."""
    same = (lambda c: c) if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    for c in columns:
        n = sum(same(x) == same(c) for x in df.columns)
        if n != 1 or c not in df.columns:
            raise DataValidationError(f"column {c} is missing" if c not in df.columns else f"{n} columns are named {c}", columns=df.columns)


def _order(order_by: str, id_column: str, *more: Column) -> Column:
    """A total order of rows, the same for the same rows once stored; structs compare field by field, nulls first."""
    return F.struct(F.col(order_by).alias("by"), F.col(id_column).alias("id"), *[c.alias(f"more{i}") for i, c in enumerate(more)], F.monotonically_increasing_id().alias("row")).alias("_ord")


def _dealt(rows: DataFrame, key: str = "name", by: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """rows with a deal (by a hash of `by`), and (key, deals) of the keys that have several."""
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > DEAL).select(key, F.ceil(F.col("n") / DEAL).cast("int").alias("deals"))
    hot = materialize(hot, "deals")
    return join_dealt(rows, hot, key, "left").withColumn("deal", F.coalesce(F.pmod(F.xxhash64(by), F.col("deals")).cast("int"), F.lit(0))).drop("deals"), hot


def _ranged(rows: DataFrame, key: str, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows with a deal, and (key, deal, low, high) of the keys that have several; rows as they are and None without any. Deals are ranges of `at`, which
    tells rows apart, so that two deals need not meet if one ends before the other begins. A row is copied once for each
    cell it goes to, so deals grow with what a row reaches: copies are then in proportion to rows, not to pairs."""
    sizes = materialize(rows.groupBy(key).agg(F.count("*").alias("n")), "sizes")
    all_rows, most = sizes.agg(F.sum("n"), F.max("n")).first()
    if (most or 0) <= DEAL:
        return rows, None
    a, b = (sizes.select(F.col(key).alias(f"{key}_{x}"), F.col("n").cast("double").alias(f"n_{x}")) for x in "ab")
    reached = edges.join(a, f"{key}_a").join(b, f"{key}_b").agg(F.sum(F.col("n_a") * F.col("n_b"))).first()[0] or 0.0
    size = max(DEAL, math.ceil(reached / all_rows / CELLS))
    hot = materialize(sizes.where(F.col("n") > size).withColumn("deals", F.ceil(F.col("n") / size)), "deals")
    numbered = join_dealt(rows.select(key, "at"), hot, key).withColumn("_hash", F.xxhash64(key))
    ranks = running(numbered, [F.col("_hash"), F.col("at")], {"rank": F.lit(1)}, {"rank": "_hash"})
    ranks = ranks.select(key, "at", F.expr("cast(rank * deals div n as int)").alias("deal"))
    dealt = materialize(rows.join(ranks.select("at", "deal"), "at", "left").withColumn("deal", F.coalesce("deal", F.lit(0))), "dealt")
    return dealt, materialize(ranks.groupBy(key, "deal").agg(F.min("at").alias("low"), F.max("at").alias("high")), "spans")


def expand_classes(rows: DataFrame, key: str, edges: DataFrame, more: list[str]) -> DataFrame:
    """Pairs (id1, id2, name1, name2, what edges(<key>_a, <key>_b, ...) hold, at1, at2) of rows(id, raw, at, key, more) whose keys
    edges link in this direction, the row of lesser `at` first; with <column>_1 and <column>_2 for each of more."""
    dealt, spans = _ranged(rows, key, edges)
    a, b = (
        dealt.select(F.col("id").alias(f"id{n}"), F.col("raw").alias(f"name{n}"), F.col("at").alias(f"at{n}"), *[F.col(f"`{c}`").alias(f"{c}_{n}") for c in more], F.col(key).alias(f"name_{x}"), *([] if spans is None else [F.col("deal").alias(f"deal_{x}")]))
        for n, x in ((1, "a"), (2, "b"))
    )
    told = [c for c in edges.columns if c not in (f"{key}_a", f"{key}_b")]
    cells = edges.select(F.col(f"{key}_a").alias("name_a"), F.col(f"{key}_b").alias("name_b"), *told)
    if spans is not None:
        for x in "ab":
            span = spans.select(F.col(key).alias(f"name_{x}"), F.col("deal").alias(f"deal_{x}"), F.col("low").alias(f"_low_{x}"), F.col("high").alias(f"_high_{x}"))
            cells = cells.join(span, f"name_{x}", "left").withColumn(f"deal_{x}", F.coalesce(f"deal_{x}", F.lit(0)))
        apart = F.coalesce(F.col("_low_a") >= F.col("_high_b"), F.lit(False))
        cells = cells.where(~apart).drop("_low_a", "_high_a", "_low_b", "_high_b")
    return _meet(a, b, cells).where("at1 < at2").select("id1", "id2", "name1", "name2", *told, *[f"`{c}_{n}`" for n in (1, 2) for c in more], "at1", "at2")


def _expand(a: DataFrame, b: DataFrame, edges: DataFrame, hot_a: DataFrame, hot_b: DataFrame) -> DataFrame:
    """Rows of a (name_a, deal_a) and of b (name_b, deal_b) whose names edges links. A pair of names is a grid of deals."""
    cells = edges
    for side, hot in (("a", hot_a), ("b", hot_b)):
        counts = hot.select(F.col("name").alias(f"name_{side}"), "deals")
        cells = cells.join(counts, f"name_{side}", "left").withColumn(f"deal_{side}", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("deals")
    return _meet(a, b, cells)


def _meet(a: DataFrame, b: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of a and b by the cells of deals in which they meet, so no key means more pairs than two deals do, however many rows
    of a have names that are linked to one name of b. The number of tasks is fixed since few bytes mean many pairs."""
    of_a, of_b = ([c for c in (f"name_{x}", f"deal_{x}") if c in cells.columns] for x in "ab")
    cell = [*of_a, *of_b]
    return spread(a.join(cells, of_a), *cell).join(b.join(cells.select(cell), of_b), cell)


@dataclass
class FuzzyMatcher:
    """Finds pairs of rows whose names are alike. Options as in the reference: see the README."""

    threshold: float = 80.0
    scorer: str = "token_sort_ratio"
    max_matches_per_entity: int | None = None
    #: Tasks and names per tile of the comparison; by default as many as the session's settings and TILE say.
    n_workers: int | None = None
    batch_size: int | None = None
    lowercase: bool = True
    strip_whitespace: bool = True
    remove_punctuation: bool = False
    punctuation_pattern: str = N.PUNCTUATION
    score_multiplier: float = 1.0
    scale_cutoff: bool = False
    shared_degrees: bool = False

    def __post_init__(self) -> None:
        S.scorer(self.scorer)

    def _name_pairs(self, left: DataFrame, right: DataFrame | None = None) -> DataFrame:
        return name_pairs(left, right, self.scorer, self.threshold, self.score_multiplier, self.scale_cutoff, tile=self.batch_size, tasks=self.n_workers)

    def normalised(self, name: Column) -> Column:
        return N.preprocess(name, self.lowercase, self.strip_whitespace, self.remove_punctuation, self.punctuation_pattern)

    def _rows(self, df: DataFrame, id_column: str, name_column: str, order_by: str | None) -> DataFrame:
        _has(df, id_column, name_column)
        ordered = df.select(F.col(id_column).alias("id"), F.col(name_column).alias("raw"), _order(order_by or id_column, id_column, F.col(name_column)))
        return ordered.where("raw is not null").withColumn("name", self.normalised(F.col("raw"))).where("name <> ''")

    def _describe(self, **more) -> dict:
        return {"threshold": self.threshold, "scorer": self.scorer, **more, "preprocessing": {"lowercase": self.lowercase, "strip_whitespace": self.strip_whitespace, "remove_punctuation": self.remove_punctuation}}

    def find_name_pairs(self, df: DataFrame, name_column: str = "name") -> DataFrame:
        """Pairs of distinct normalised names; equal names are one and do not pair."""
        names = df.where(F.col(name_column).isNotNull()).select(self.normalised(F.col(name_column)).alias("name")).where("name <> ''")
        return self._name_pairs(names)

    def find_matches(self, df: DataFrame, id_column: str = "id", name_column: str = "name", order_by: str | None = None) -> MatchResult:
        """Pairs (id1, id2, name1, name2, similarity_score) of rows, the earlier row (by order_by, else id; nulls first,
        then by id and name; wholly equal rows in any order) first. Repeated ids are rows of their own.

        This expands equal names into all their pairs, as the reference does; for large groups of equal names
        take find_name_pairs or the pipeline, which cluster names and join ids afterwards.
        """
        rows, seen = materialize_counted(self._rows(df, id_column, name_column, order_by), "entities", {"total_entities": F.count(F.lit(1))})
        links = materialize(self._name_pairs(rows), "links")
        ranked = materialize(running(rows, [F.col("_ord")], {"at": F.lit(1)}).drop("_ord"), "ranked")
        classes = NameClasses(ranked, links, self._same())
        pairs = lambda: classes.expand().drop("at1", "at2")
        if self.max_matches_per_entity is not None:
            pairs, classes = degree_cap(classes.expand(), self.max_matches_per_entity, [F.col("at1")], [F.col("at2")], F.struct(-F.col("similarity_score"), "at1", "at2")).drop("at1", "at2"), None
        n, size = seen["total_entities"], self.batch_size or TILE
        few = {"message": "a pair takes two rows with a name"} if n < 2 else {}
        return MatchResult(pairs, self._describe(**seen, batches_processed=-(-n // size), **few), classes)

    def _same(self) -> float | None:
        """The score of equal names, None if it does not satisfy the predicate."""
        top = 1.0 if self.scorer.startswith("jaro") else 100.0
        raw_ok = top >= (self.threshold / self.score_multiplier if self.scale_cutoff else self.threshold)
        return top * self.score_multiplier if raw_ok and top * self.score_multiplier >= self.threshold else None

    def find_cross_matches(self, df1: DataFrame, df2: DataFrame, id_column1: str = "id", id_column2: str = "id", name_columns1: str | list[str] = "name", name_columns2: str | list[str] = "name", order_by1: str | None = None, order_by2: str | None = None) -> MatchResult:
        """Pairs between two tables. With several name columns every combination is tried and each pair keeps its
        best score (first combination on ties); columns that are missing are skipped; no degree cap then."""
        c1 = [name_columns1] if isinstance(name_columns1, str) else list(name_columns1)
        c2 = [name_columns2] if isinstance(name_columns2, str) else list(name_columns2)
        single = len(c1) == len(c2) == 1
        here1, here2 = [c for c in c1 if single or c in df1.columns], [c for c in c2 if single or c in df2.columns]
        long1, seen1 = self._long(df1, id_column1, here1, order_by1, single)
        long2, seen2 = self._long(df2, id_column2, here2, order_by2, single)
        alike = materialize(self._name_pairs(long1, long2), "names")
        (dealt1, hot1), (dealt2, hot2) = _dealt(long1), _dealt(long2)
        a = dealt1.select(F.col("id").alias("id1"), F.col("raw").alias("name1"), F.col("_ord").alias("o1"), F.col("name").alias("name_a"), F.col("col").alias("matched_column1"), F.col("at").alias("at1"), F.col("deal").alias("deal_a"))
        b = dealt2.select(F.col("id").alias("id2"), F.col("raw").alias("name2"), F.col("_ord").alias("o2"), F.col("name").alias("name_b"), F.col("col").alias("matched_column2"), F.col("at").alias("at2"), F.col("deal").alias("deal_b"))
        pairs = _expand(a, b, alike, hot1, hot2)
        if single:
            pairs = pairs.withColumn("matched_column1", F.lit("name")).withColumn("matched_column2", F.lit("name"))
            if self.max_matches_per_entity is not None:
                keys = ([F.col("o1.row")], [F.col("o2.row")])
                pairs = degree_cap(pairs, self.max_matches_per_entity, *keys, F.struct(-F.col("similarity_score"), "o1", "o2"), two_sided=not self.shared_degrees)
        else:
            best = Window.partitionBy("id1", "id2").orderBy(F.desc("similarity_score"), "at1", "at2")
            pairs = pairs.withColumn("rn", F.row_number().over(best)).where("rn = 1")
        out = pairs.select("id1", "id2", "name1", "name2", "similarity_score", "matched_column1", "matched_column2", F.lit("df1").alias("source1"), F.lit("df2").alias("source2"))
        kind = {"matching_type": "cross_dataset"} if single else {"matching_type": "cross_dataset_multi_column", "name_columns1": c1, "name_columns2": c2, "total_combinations_tried": len(c1) * len(c2)}
        few = {} if seen1 and seen2 else {"message": "a pair takes a row with a name in each table"}
        classes = NameClasses(long1, alike, others=long2) if single and self.max_matches_per_entity is None else None
        return MatchResult(out, self._describe(df1_entities=seen1, df2_entities=seen2, **kind, **few), classes)

    def _long(self, df: DataFrame, id_column: str, columns: list[str], order_by: str | None, named_only: bool) -> tuple[DataFrame, int]:
        """Rows (id, _ord, at, col, raw, name), one per name of a row, and how many rows there are, or with named_only have
        a name; the one scan of df that writes them counts."""
        _has(df, id_column, *columns)
        seen, n = Observation(), F.count(F.lit(1)).alias("n")
        texts = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("col"), F.col(c).cast("string").alias("raw")) for i, c in enumerate(columns)]) if columns else F.array().cast("array<struct<at:int,col:string,raw:string>>")
        rows = df.select(F.col(id_column).alias("id"), _order(order_by or id_column, id_column), texts.alias("texts"))
        long = (rows if named_only else rows.observe(seen, n)).select("id", "_ord", F.explode("texts").alias("t")).select("id", "_ord", "t.at", "t.col", "t.raw")
        named = long.where("raw is not null").withColumn("name", self.normalised(F.col("raw"))).where("name <> ''")
        stored = materialize(named.observe(seen, n) if named_only else named, "side")
        return stored, seen.get["n"]
