"""Mixing sources to target sizes by a low-discrepancy schedule.

Every source is a stream: its documents in a shuffled order that a hash of doc_id fixes, told again for a
second pass. The stream is cut into blocks of BLOCK words. Slot t of the schedule takes the point
frac((t + 1/2) / golden ratio); the points, mapped through the cumulative shares of the sources, give each
slot its source. The r-th slot of a source takes the r-th block of its stream (an equality join on source
and rank). Shares count blocks, so a source's number of slots misses its quota by a few at most: ranks
beyond the quota are left out, ranks that are missing follow after the last slot. The last block of a
source is cut where its target is reached, so what it gives is its target rounded to a whole word.

Targets: source k in code point order (null last) weighs weights[k mod 3]; targets are proportional to
weights, at most `passes` times a source's size, what is above being dealt to the others again.

Ranks of sources and of slots and running sums of sizes are taken over ranges of the whole order, so that neither a
source with most of the rows nor a great number of sources is gathered in one task; tables with one row per source
are joined to documents and slots under salted keys.

Edge cases: null or blank text has size 0 and nothing is taken of it; null source is a source of its own;
rows with null doc_id are shuffled by their text; repeated rows are documents of their own; very long texts are told
whole, over many blocks; other columns are ignored; empty tables and tables without words give targets of 0.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.text import count_words
from samewise.operators.order import running
from samewise.sources.shared import materialize

RATIO, WEIGHTS, PASSES = 1.5, (5, 2, 1), 2
BLOCK = 1024
_RATIO = Fraction("0.61803398874989484820458683436563811772")  # 1 / golden ratio
_GOLDEN, _GOLDEN_20 = float(_RATIO), float(_RATIO * 2**20 % 1)  # the latter for the upper bits of a slot number
_CELLS, _SALTS = 1024, 64


def _join(rows: DataFrame, small: DataFrame, column: str, salt) -> DataFrame:
    """rows with the columns of the row of small that has the same `column` (nulls are equal); the many rows of one
    value are dealt to _SALTS tasks by the expression salt."""
    a = rows.withColumn("_salt", F.pmod(salt, F.lit(_SALTS))).alias("a")
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long")))).alias("b")
    joined = a.join(b, F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}")) & (F.col("a._salt") == F.col("b._salt")))
    return joined.select(*[F.col(f"a.{c}") for c in rows.columns], *[F.col(f"b.{c}") for c in small.columns if c != column])


def sizes(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size, key): words of the whole text; key orders a source's documents."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("key"))


def targets(sources: DataFrame, ratio: float = RATIO, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sources(source, source_size) with sid, source_start (the size of those before it), target (double) and quota
    (whole words)."""
    numbered = running(sources, [F.col("source").asc_nulls_last()], {"sid": F.lit(1), "source_start": F.col("source_size")}).withColumn("sid", (F.col("sid") + 1).cast("int"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    capped = numbered.withColumn("weight", weight).withColumn("cap", passes * F.col("source_size"))
    # the sources that stop at their cap come first in this order; the first that does not sets the level of all others
    tight = running(capped, [F.col("cap") / F.col("weight"), F.col("sid")], {"at": F.lit(1), "caps": F.col("cap"), "weights": F.col("weight")})
    size, every = tight.agg(F.sum("source_size"), F.sum("weight")).first()
    level = tight.withColumn("level", (ratio * F.lit(size or 0) - F.col("caps")) / (F.lit(every or 0) - F.col("weights")))
    first = level.where(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min("at"), F.min_by("level", "at")).first()
    cap = F.col("cap").cast("double")
    target = cap if first[0] is None else F.when(F.col("at") < first[0], cap).otherwise(F.least(F.lit(first[1]) * F.col("weight"), cap))
    return level.select("source", "source_size", "sid", "source_start", target.alias("target")).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))


def place(sized: DataFrame, **how) -> DataFrame:
    """sized with source_size, sid, target, quota and start: the words of its source that come before a document."""
    by_source = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    joined = _join(sized, by_source, "source", F.xxhash64("key"))
    run = running(joined, [F.col("sid"), F.col("key"), F.col("doc_id"), F.col("size")], {"before": F.col("size")})
    return run.select("doc_id", "source", "size", "source_size", "sid", "target", "quota", (F.col("before") - F.col("source_start")).alias("start"))


def schedule(quotas: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (slot, sid, rank) from quotas(sid, quota): each source has the ranks 0 to ceil(quota / block) - 1 once."""
    spark = quotas.sparkSession
    needs = quotas.select("sid", F.ceil(F.col("quota") / block).cast("long").alias("need")).where("need > 0")
    share = materialize(running(needs, [F.col("sid")], {"low": F.col("need")}).withColumn("high", F.col("low") + F.col("need")), "shares")
    n = share.agg(F.max("high")).first()[0] or 0
    cell = lambda c: F.least(F.lit(_CELLS - 1), F.floor(c * _CELLS / F.lit(max(n, 1)))).cast("int")
    cells = share.select("sid", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    t = F.col("id")
    whole = F.shiftright(t, 20)
    point = F.pmod((t - whole * (1 << 20) + 0.5) * _GOLDEN + F.pmod(whole * F.lit(_GOLDEN_20), F.lit(1.0)), F.lit(1.0))
    points = spark.range(n).select(t.alias("slot"), (point * n).alias("x")).withColumn("cell", cell(F.col("x")))
    drawn = running(points.join(cells, "cell").where("low <= x and x < high").select("sid", "slot"), [F.col("sid"), F.col("slot")], {"at": F.lit(1)})
    drawn = materialize(drawn, "drawn")
    firsts = drawn.groupBy("sid").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    known = materialize(share.join(firsts, "sid", "left").select("sid", "need", "first", F.least(F.coalesce("n", F.lit(0)), F.col("need")).alias("had")), "known")
    ranked = _join(drawn, known.where("first is not null"), "sid", F.col("slot")).withColumn("rank", F.col("at") - F.col("first"))
    kept = ranked.where("rank < need").select("slot", "sid", "rank")
    late = running(known.where("had < need"), [F.col("sid")], {"after": F.col("need") - F.col("had")})
    tail = late.select("sid", "had", "after", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("rank")).select((F.lit(n) + F.col("after") + F.col("rank") - F.col("had")).alias("slot"), "sid", "rank")
    return kept.union(tail)


def pieces(placed: DataFrame, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """Rows of placed once per pass and block they have words in: pass_, rank (the block), from_word, n (words of it)."""
    first = F.col("start") + F.col("pass_") * F.col("source_size")
    last = F.least(first + F.col("size"), F.col("quota"))
    told = placed.withColumn("pass_", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("first", first).withColumn("last", last).where("first < last")
    split = told.withColumn("rank", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))))
    low = F.greatest(F.col("first"), F.col("rank") * block)
    return split.withColumn("from_word", low - F.col("first")).withColumn("n", F.least(F.col("last"), (F.col("rank") + 1) * block) - low).drop("first", "last")


def mix(docs: DataFrame, block: int = BLOCK, **how) -> tuple[DataFrame, DataFrame]:
    """(placed, mixed): every document with its place, and the mix itself: rows (slot, sid, rank, doc_id, start,
    pass_, from_word, n), in the order of slot and then of pass_ and start."""
    placed = materialize(place(materialize(sizes(docs), "sizes"), **how), "placed")
    slots = schedule(placed.groupBy("sid").agg(F.first("quota").alias("quota")), block)
    parts = pieces(placed, block, how.get("passes", PASSES)).select("sid", "rank", "doc_id", "start", "pass_", "from_word", "n")
    return placed, parts.join(slots, ["sid", "rank"])


def taken(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """placed with `taken`, the words that the mix takes of each document, `first_slot`, where it first comes in the mix
    (null if it does not), and `n_slots`, in how many slots. (sid, start) tells documents with words apart."""
    sums = mixed.groupBy("sid", "start").agg(F.sum("n").alias("taken"), F.min("slot").alias("first_slot"), F.count_distinct("slot").alias("n_slots"))
    some = placed.where("size > 0").join(sums, ["sid", "start"], "left")
    none = placed.where("size = 0").withColumns({"taken": F.lit(0), "first_slot": F.lit(None), "n_slots": F.lit(0)})
    long = lambda c: F.col(c).cast("long").alias(c)
    columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), long("first_slot"), F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots")]
    return some.select(*columns).union(none.select(*columns))
