import hashlib
import math
import random

import numpy as np
import pytest

from samewise.llm import codes as C
from samewise.llm.q_codes import OP13_SQL, op13_vector_codes
from tests.compare import compare

SCHEMA = "vec_id long, embedding array<float>, label int, code string, x int, deal int, error long"


def brute(rows):
    """Plain k-means over Python integers: every entry for every part."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) for c in v], y) for i, v, y in rows if v is not None and not any(c is None or math.isnan(c) or math.isinf(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-max((len(v) for _, v, _ in kept), default=0) // 4)
    parts = [[(v + [0] * (4 * w - len(v)))[p * w : (p + 1) * w] for _, v, _ in kept] for p in range(4)]
    books = [part[:256] for part in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(4):
        for part, book in zip(parts, books, strict=True):
            got = [near(x, book)[1] for x in part]
            for e in set(got):
                mine = [x for x, g in zip(part, got, strict=True) if g == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    best = [[near(x, book) for x in part] for part, book in zip(parts, books, strict=True)]
    errors = [sum(b[n][0] for b in best) for n in range(len(kept))]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{b[n][1]:02x}" for b in best), errors[n], sum(e for e, k in zip(errors, kept, strict=True) if k[2] == y), sha) for n, (i, _, y) in enumerate(kept)), key=repr)


def rows_of(n, dims, seed):
    rnd = random.Random(seed)
    near = [[rnd.gauss(0, 0.2) for _ in range(dims)] for _ in range(9)]
    out = [(i * 3 % 1000, [c + rnd.gauss(0, 0.05) for c in near[i % 9]], rnd.choice([None, 1, 2])) for i in range(n)]
    return out + [(7, None, 1), (8, [None] * dims, 1), (9, [math.nan] * dims, 2), (10, [math.inf] * dims, 2), (11, [-math.inf] * dims, None)]


@pytest.mark.parametrize(("n", "dims", "seed"), [(330, 12, 1), (40, 8, 2), (300, 5, 3)])
def test_against_brute_force(spark, tmp_path, n, dims, seed):
    rows = rows_of(n, dims, seed)
    rows += [(None, rows[3][1], None), (None, rows[3][1], None), rows[0], rows[0], (5, [0.25] * 3, 4), (6, [], 5)]
    spark.createDataFrame([(*r, "a", 1, 2, 3) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((tuple(r) for r in op13_vector_codes(spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows)
    compare(spark, "op13", op13_vector_codes, OP13_SQL, str(tmp_path))


def test_empty(spark, tmp_path):
    spark.createDataFrame([(1, None, 1, "a", 1, 2, 3)], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_vector_codes(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_cells_prune_and_lose_nothing():
    rnd = np.random.default_rng(4)
    entries = np.floor(rnd.normal(0, 128, (256, 16))).astype(np.int64)
    entries[40] = entries[7]  # a tie goes to the lower index
    x = np.floor(rnd.normal(0, 128, (3000, 16))).astype(np.int64)
    x[2000:] = x[:1000]
    x[5] = entries[40]
    want = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    for cell, room in ((32, 1 << 16), (200, 1 << 16), (32, 50), (1, 1 << 16)):
        cells = C.Cells(entries, cell, room)
        for at in range(0, 3000, 700):
            index, best = cells.nearest(x[at : at + 700])
            assert (index == want[at : at + 700].argmin(axis=1)).all() and (best == want[at : at + 700].min(axis=1)).all()
        assert len(cells.known) <= max(room, 700)
        if cell == 32:
            assert cells.evaluated < 0.2 * 256 * 3000
    assert index[0] == want[2800].argmin()


def test_far_components_are_held(spark):
    rows = [(i, [3e38 if i else -3e38, 1e-3 * i, 0.0, 0.0], None) for i in range(5)]
    df = spark.createDataFrame([(*r, "", 0, 0, 0) for r in rows], SCHEMA)
    x = sorted(r.x for r in C.integers(df).collect())
    assert x[0][0] == -C.FARTHEST and x[-1][0] == C.FARTHEST
    assert C.encode(C.integers(df), C.train(C.integers(df))).count() == 5
