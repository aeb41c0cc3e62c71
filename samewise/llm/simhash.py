"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits. Two of them that differ in at most 2 bits differ in at most one bit in one of
their two 32-bit segments, so that segment is equal once one position of it is struck out. Each distinct
fingerprint is indexed under its 2 x 32 one-wildcard segment variants, equal keys are joined, and pairs
are verified by counting differing bits.

Keys that more than BUCKET fingerprints share (many near copies of one text) emit no pairs. All their
members go an exact way instead: two fingerprints are within 2 bits of each other exactly if some point
is within 1 bit of both, so each member is indexed under itself and its 64 one-bit neighbours. At most 65
fingerprints can meet at a point, and all that do are linked; they get one star of edges. A pair of near
texts shares a key; if that key is small the join finds it, otherwise both are members here.

Texts: A-Z lower-cased, words are runs of anything but ASCII white space, 3-word shingles with repeats,
fewer words make one shingle, none give fingerprint zero.

Edge cases: null text counts as empty; rows without doc_id are fingerprinted and linked as others and get
the smallest doc_id of their component (null if it has none); repeated rows and several texts under one
doc_id are separate rows; other columns are carried along or ignored; a very long text is hashed in chunks; empty
tables give empty results. Rows of one fingerprint are dealt to many tasks where they are joined to its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.llm.text import fresh
from samewise.operators.components import connected_components
from samewise.sources.shared import materialize

SEGMENTS, WIDTH, DISTANCE = 2, 32, 2
BUCKET = 32
_CHUNK, _DEALS = 1 << 15, 1009


def fingerprint(text: bytes | None) -> int:
    """The fingerprint of one text as a signed 64-bit integer; shingles are hashed and counted in chunks."""
    w = (text or b"").lower().split()  # of bytes: splits at ASCII white space, lowers A-Z only
    if not w:
        return 0
    n = max(1, len(w) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = w[at : at + _CHUNK + 2]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if len(w) > 2 else [b" ".join(w)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [batch.column(i) for i in range(batch.num_columns - 1)]
        prints = pa.array([fingerprint(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.int64())
        yield pa.RecordBatch.from_arrays([*kept, prints], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and the fingerprint `fp` (long) of every row."""
    picked = docs.select(*keep, F.col(text).cast("binary").alias("fp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(_prints, f"{schema}, fp long")


def _variants() -> Column:
    """The keys of fp: segment and struck-out position above, the segment without that bit below."""
    out = []
    for s in range(SEGMENTS):
        segment = F.shiftrightunsigned("fp", WIDTH * s).bitwiseAND(F.lit((1 << WIDTH) - 1))
        for j in range(WIDTH):
            out.append(segment.bitwiseAND(F.lit(((1 << WIDTH) - 1) ^ (1 << j))).bitwiseOR(F.lit((s * WIDTH + j) << WIDTH)))
    return F.explode(F.array(*out))


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints `fp` that connect all that are within DISTANCE bits.

    prints holds each fingerprint once.
    """
    keyed = prints.select("fp", _variants().alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    # a merge join at every size: it can split crowded keys, and what it shuffles follows the input
    met = materialize(keyed.join(shared.hint("merge"), "key"), "met")
    small = met.where(F.col("n") <= bucket).select("key", "fp")
    pairs = (
        small.withColumnRenamed("fp", "src").join(small.withColumnRenamed("fp", "dst"), "key")
        .where("src < dst").where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= DISTANCE).select("src", "dst")
    )
    crowded = met.where(F.col("n") > bucket).select("fp").distinct()
    ball = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << j if j < 63 else -(1 << 63))) for j in range(64)])).alias("point"))
    hubs = ball.groupBy("point").agg(F.min("fp").alias("src"), F.count("*").alias("n")).where("n > 1")
    stars = ball.join(hubs, "point").where("fp <> src").select("src", F.col("fp").alias("dst"))
    return pairs.union(stars).distinct()


def components(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (fp, root, component_id): each distinct fingerprint of prints(doc_id, fp), the least fingerprint of
    its component and the component's smallest doc_id."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "prints")
    roots = materialize(connected_components(links(distinct.select("fp"), bucket)).select(F.col("node").alias("fp"), F.col("component").alias("root")), "roots")
    least = distinct.join(roots, "fp").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = roots.join(least, "root")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows (doc_id, fp, component_id), one per row of docs(doc_id, text)."""
    prints = materialize(fingerprints(docs, ["doc_id"]).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(_DEALS))), "fp")
    # a fingerprint that is there once has one deal, one that most rows share has _DEALS of them
    dealt = prints.select("fp", "deal").distinct().join(components(prints, bucket).select("fp", "component_id"), "fp")
    return prints.join(dealt, ["fp", "deal"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id (a row without doc_id only if none
    has one), among equal ones the least by a hash of the row, and one of wholly equal rows.

    The winners are found on (doc_id, hash) alone; texts are joined to them afterwards.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    mark = fresh("mark", docs.columns)
    first_id, first_mark, copies = (fresh(x, [*docs.columns, mark]) for x in ("first_id", "first_mark", "copies"))
    marked = docs.withColumn(mark, F.xxhash64(F.struct(*columns)))
    prints = materialize(fingerprints(marked, ["doc_id", mark]).withColumnRenamed(mark, "mark"), "fp")
    firsts = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first"))
    classes = components(prints.select("doc_id", "fp"), bucket).join(firsts, "fp")
    winners = classes.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.mark")
    counts = prints.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    same = (F.col("w.mark") == F.col("c.mark")) & F.col("w.doc_id").eqNullSafe(F.col("c.doc_id"))
    chosen = materialize(winners.alias("w").join(counts.alias("c"), same).select(F.col("w.doc_id").alias(first_id), F.col("w.mark").alias(first_mark), F.col("c.copies").alias(copies)), "winners")
    joined = marked.join(chosen, (F.col(mark) == F.col(first_mark)) & F.col("doc_id").eqNullSafe(F.col(first_id)))
    single = joined.where(F.col(copies) == 1).select(*columns)
    if not chosen.where(F.col(copies) > 1).limit(1).count():
        return single
    return single.union(joined.where(F.col(copies) > 1).dropDuplicates([mark, first_id]).select(*columns))
