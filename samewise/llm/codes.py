"""Vector codes: product quantisation by k-means on integers, nearest entries through memoised grid cells.

Components become floor(1024 x); vectors are cut into PARTS equal consecutive parts, each with a codebook of its own. A
codebook starts as that part of the first ENTRIES vectors by vec_id; each round assigns every part to its nearest entry
(least squared distance, ties to the lower index) and replaces each used entry by the componentwise floor of the mean.

Nearest entries: space is cut into boxes of CELL per component. For the box of a part's vector the least and the greatest
distance to every entry follow component by component; an entry whose least distance exceeds another's greatest one is
dominated all over the box. What is left is kept in a table under the box, and only that is evaluated exactly, for
this vector and for all that fall into the same box. The table holds ROOM boxes at most and starts anew when it is full,
which costs time and changes nothing.

A task adds up the vectors of each entry and sends one row per entry; the driver sees codebooks only (at most
ENTRIES x components numbers), however many vectors there are. All sums are of integers, so the order of rows does not
matter.

Edge cases: rows whose vector is null or holds null, NaN or infinite components are dropped; shorter vectors are filled
up with zeros to the longest's length, and that to a multiple of PARTS; an empty vector has the code of its zeros;
scaled components beyond +-2^26 count as that; null vec_ids come after all others, rows of one vec_id in the order of
their vectors; repeated rows are coded each; null labels are one label; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.sources.shared import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
CELL, ROOM, FARTHEST = 32, 1 << 16, 1 << 26
_PAIRS, _BOXES, _DEALS = 1 << 17, 2048, 1009

Codebooks = list[np.ndarray]


def integers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, label, x): the valid vectors as arrays of integers of one length, a multiple of PARTS; stored."""
    x = F.col(vector)
    valid = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.lit(float(-FARTHEST)), F.least(F.lit(float(FARTHEST)), c.cast("double") * SCALE))).cast("int"))
    rows = embeddings.where(valid).select("vec_id", "label", whole.alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    filled = F.when(F.size("x") == width, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0), F.lit(width) - F.size("x"))))
    return materialize(rows.withColumn("x", filled), "vectors")


class Cells:
    """Nearest entries of one codebook, by boxes of `cell` units a side."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, room: int = ROOM) -> None:
        self.entries, self.cell, self.room = entries, cell, room
        self.known: dict[bytes, np.ndarray] = {}
        self.evaluated = 0

    def _candidates(self, boxes: np.ndarray) -> np.ndarray:
        """By box and entry whether the entry is the nearest one somewhere, as far as distances to the box can tell."""
        least = np.zeros((len(boxes), len(self.entries)), np.int64)
        most = np.zeros_like(least)
        for d in range(boxes.shape[1]):
            at, back = np.unique(boxes[:, d], return_inverse=True)
            low, e = at[:, None] * self.cell, self.entries[None, :, d]
            high = low + self.cell - 1
            least += (np.maximum(np.maximum(low - e, e - high), 0) ** 2)[back]
            most += (np.maximum(high - e, e - low) ** 2)[back]
        return least <= most.min(axis=1)[:, None]

    def _look_up(self, boxes: np.ndarray) -> np.ndarray:
        keys = [b.tobytes() for b in boxes]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > self.room:
            self.known.clear()
            new = list(range(len(keys)))
        for at in range(0, len(new), _BOXES):
            part = new[at : at + _BOXES]
            for i, mask in zip(part, np.packbits(self._candidates(boxes[part]), axis=1), strict=True):
                self.known[keys[i]] = mask
        return np.unpackbits(np.stack([self.known[k] for k in keys]), axis=1, count=len(self.entries)).astype(bool)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance, by row of x."""
        boxes, back = np.unique(x // self.cell, axis=0, return_inverse=True)
        masks = self._look_up(np.ascontiguousarray(boxes))
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        counts = masks.sum(axis=1)[back.reshape(-1)]
        edges = np.searchsorted(np.cumsum(counts), np.arange(_PAIRS, counts.sum() + _PAIRS, _PAIRS))
        for low, high in zip([0, *edges + 1], [*edges + 1, len(x)], strict=True):
            if low >= min(high, len(x)):
                continue
            i, j = np.nonzero(masks[back.reshape(-1)[low:high]])
            distance = ((x[low:high][i] - self.entries[j]) ** 2).sum(axis=1)
            self.evaluated += len(i)
            starts = np.concatenate(([0], np.cumsum(counts[low:high])[:-1]))
            best[low:high] = np.minimum.reduceat(distance, starts)
            first = np.nonzero(distance == best[low:high][i])[0]
            rows, at = np.unique(i[first], return_index=True)  # entries come in order, so the first is the lowest index
            index[low + rows] = j[first][at]
        return index, best


def _vectors(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """Rows x parts x components."""
    return batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, width)


def _sums(codebooks: Codebooks):
    """By task one row (part, entry, n, sums) for each used entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        counts, sums = [np.zeros(len(c), np.int64) for c in codebooks], [np.zeros_like(c) for c in codebooks]
        for batch in batches:
            x = _vectors(batch, len(codebooks), codebooks[0].shape[1])
            for p, c in enumerate(cells):
                index, _ = c.nearest(x[:, p])
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                counts[p] += np.bincount(index, minlength=len(counts[p]))
                if len(used):
                    sums[p][used] += np.add.reduceat(x[order, p], starts)
        rows = [(p, e) for p, n in enumerate(counts) for e in np.nonzero(n)[0].tolist()]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, _ in rows], pa.int32()), "entry": pa.array([e for _, e in rows], pa.int32()),
            "n": pa.array([int(counts[p][e]) for p, e in rows], pa.int64()), "sums": pa.array([sums[p][e].tolist() for p, e in rows], pa.list_(pa.int64())),
        })

    return run


def _codes(codebooks: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        for batch in batches:
            x = _vectors(batch, len(codebooks), codebooks[0].shape[1])
            found = [c.nearest(x[:, p]) for p, c in enumerate(cells)]
            text = ["".join(f"{e:02x}" for e in row) for row in zip(*[f[0].tolist() for f in found], strict=True)]
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], [*batch.schema.names[:-1], "code", "error"])

    return run


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of vectors(vec_id, label, x), one array (entries, components) per part; none for an empty table."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    if not first:
        return []
    start = np.array([r.x for r in first], np.int64).reshape(len(first), parts, -1)
    codebooks = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    for _ in range(rounds):
        partial = vectors.select("x").mapInArrow(_sums(codebooks), "part int, entry int, n long, sums array<long>")
        cells = partial.select("part", "entry", "n", F.posexplode("sums").alias("at", "v")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
        for r in cells.collect():
            codebooks[r.part][r.entry, r.at] = r.v // r.n
    return codebooks


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """Rows (vec_id, label, code, error) of vectors."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name in ("vec_id", "label"))
    if not codebooks:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where(F.lit(False))
    return vectors.select("vec_id", "label", "x").mapInArrow(_codes(codebooks), f"{schema}, code string, error long")


def digest(codebooks: Codebooks) -> str:
    """SHA-256 of all entries' integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.reshape(-1).tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of all rows of its label; rows of one label are dealt to many tasks."""
    stored = materialize(coded.withColumn("deal", F.pmod(F.xxhash64("vec_id", "code"), F.lit(_DEALS))), "codes")
    sums = stored.groupBy("label").agg(F.sum("error").alias("label_error"))
    d, s = stored.select("label", "deal").distinct().alias("d"), sums.alias("s")
    dealt = d.join(s, F.col("d.label").eqNullSafe(F.col("s.label"))).select(F.col("d.label").alias("label"), "deal", "label_error").alias("m")
    rows = stored.alias("r").join(dealt, F.col("r.label").eqNullSafe(F.col("m.label")) & (F.col("r.deal") == F.col("m.deal")))
    return rows.select("r.vec_id", "r.label", "r.code", "r.error", "m.label_error")
