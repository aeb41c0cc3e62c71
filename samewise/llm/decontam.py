"""Benchmark decontamination: containment search by size-partitioned MinHash. DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits; shingles are WORDS consecutive words. An
item leaks into a document that holds at least SHARE of the item's distinct shingles.

Items are partitioned by size class (powers of two of their number q of distinct shingles). Each keeps a
bottom-k MinHash sketch, its k least shingle hashes; k is set by the upper bound of the class so that at
least one of them must be in any document that holds SHARE of the item: an item may miss
q - ceil(SHARE q) shingles, and k is larger. Documents, however long, are searched for sketch hashes only,
after dropping every hash above the largest in a sketch. So candidates lack nothing; they are verified by
counting the shared shingles as strings.

Edge cases: null text counts as empty; texts under WORDS words have no shingle, so such items match
nothing and such documents leak nothing; rows without item_id or doc_id are handled like others; of
several texts under one doc_id or item_id the best match counts; repeated rows change nothing; `clean` carries other
columns along, whatever their names; a very long text is one row, cut into shingles in memory; an empty benchmark leaves
all documents clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.text import fresh, let
from samewise.operators.order import join_dealt
from samewise.sources.shared import materialize

WORDS = 5
#: SHARE as a fraction of whole numbers: 4 / 5.
SHARE = (4, 5)
#: A side of at most so many rows or characters is broadcast; beyond it Spark shuffles both sides, dealing out the documents
#: of one hash, which may be that of a passage in very many of them.
BROADCAST_ROWS, BROADCAST_CHARS = 500_000, 8_000_000


def shingles(text: Column) -> Column:
    """array<string> of the distinct shingles."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return let(
        F.split(plain, " "),
        lambda w: F.array_distinct(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, WORDS)]))),
    )


def _hashes(text: Column) -> Column:
    return F.transform(shingles(text), lambda s: F.xxhash64(s))


def items(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, item, q, least): distinct items with their shingles; least = ceil(SHARE q)."""
    a, b = SHARE
    cut = benchmark.select("item_id", shingles(F.col("text")).alias("item")).withColumn("q", F.size("item")).where("q > 0").distinct()
    return cut.withColumn("least", F.floor((a * F.col("q") + b - 1) / b).cast("int")).withColumn("row", F.xxhash64("item"))


def sketches(cut: DataFrame) -> DataFrame:
    """Rows (item_id, row, need, h): the sketch hashes of each item, and how many of them a match must hold."""
    a, b = SHARE
    top = F.pow(F.lit(2), F.floor(F.log2(F.col("q"))) + 1) - 1  # the largest q of the size class
    k = F.least(F.col("q"), (F.floor(top * (b - a) / b) + 1).cast("int"))
    hashed = cut.select("item_id", "row", "q", "least", k.alias("k"), F.sort_array(F.transform("item", lambda s: F.xxhash64(s))).alias("hs"))
    return hashed.select("item_id", "row", (F.col("k") - (F.col("q") - F.col("least"))).alias("need"), F.explode(F.slice("hs", F.lit(1), F.col("k"))).alias("h"))


def _small(df: DataFrame, fits: bool) -> DataFrame:
    return F.broadcast(df) if fits else df


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, item_id, n_shingles, n_shared) for docs(doc_id, text): every item that a text holds."""
    cut = materialize(items(benchmark), "items")
    sketch = materialize(sketches(cut), "sketch")
    n, most = sketch.agg(F.count("*"), F.max("h")).first()
    chars = cut.agg(F.sum(F.length(F.array_join("item", "")))).first()[0] or 0
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    low = own.select("doc_id", "text_hash", F.explode(F.filter(_hashes(F.col("text")), lambda h: h <= F.lit(most if most is not None else -(2**63)))).alias("h"))
    met = low.join(F.broadcast(sketch), "h") if n <= BROADCAST_ROWS else join_dealt(low, sketch, "h")
    hits = met.groupBy("doc_id", "text_hash", "item_id", "row", "need").agg(F.count_distinct("h").alias("hits"))
    found = materialize(hits.where("hits >= need").select(F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.col("item_id").alias("item_id_"), F.col("row").alias("row_")), "candidates")
    pairs = found.join(own, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")))
    checked = pairs.join(_small(cut, chars <= BROADCAST_CHARS), (F.col("row") == F.col("row_")) & F.col("item_id").eqNullSafe(F.col("item_id_")))
    shared = checked.select("doc_id", "text_hash", "item_id", F.col("q").cast("long").alias("n_shingles"), "least", F.size(F.array_intersect(shingles(F.col("text")), F.col("item"))).cast("long").alias("n_shared"))
    return shared.where("n_shared >= least").drop("least")


def pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, n_shingles, n_shared, containment), one per pair of ids: its best match."""
    best = F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("b")
    return leaks(docs, benchmark).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.n_shingles", "b.n_shared", "b.containment")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds an item."""
    mark, bad_id, bad_mark = fresh("text_hash", docs.columns), fresh("bad_id", docs.columns), fresh("bad_hash", docs.columns)
    bad = leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(bad_id), F.col("text_hash").alias(bad_mark)).distinct()
    kept = docs.withColumn(mark, F.xxhash64("text")).join(materialize(bad, "leaks"), F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(mark) == F.col(bad_mark)), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
