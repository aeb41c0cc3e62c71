import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from samewise.llm import shards as S
from samewise.llm.q_shards import op11_sharding

SCHEMA = "doc_id long, text string, shard string, slot int, mark int, size string, at int, n int, piece int"


def rows_of(n, seed, hot=0):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(["a", "bb", "cäc", "dddd"]) for _ in range(int(rnd.paretovariate(0.8)) % 400)) for _ in range(n)]
    texts += [rnd.choice(texts) for _ in range(n // 5)] + ["the same copied text"] * hot + [None, None, "", " \n"]
    return [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, "repeated row")] * 3


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute(rows, shards):
    """The law by plain Python, for at most one task of small groups; shard and slot by (doc_id, text), sorted."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    facts = sorted(((signed(t), zlib.crc32(t.encode()), len(t.encode()) + 16), t, sorted(ids, key=lambda i: (i is not None, i or 0))) for t, ids in groups.items())
    sums = [sum(len(ids) * k[2] for k, _, ids in facts), sum(len(ids) * len(t.split()) for _, t, ids in facts), len(rows)]
    units, slots = [], defaultdict(int)
    for k, t, ids in facts:
        v = lambda n, k=k, t=t: [n * x * shards / max(y, 1) for x, y in zip((k[2], len(t.split()), 1), sums, strict=True)]
        most = max(v(len(ids)))
        per = len(ids) if most <= 1 else max(1, int(len(ids) * S.PIECE / most))
        units += [(most < S.HEAVY, v(len(ids[p : p + per])), (*k, p), ids[p : p + per]) for p in range(0, len(ids), per)]
    left = [[1.0] * 3 for _ in range(shards)]
    got = {}
    for _, v, k, ids in sorted(units, key=lambda u: (u[0], -sum(w * x * x for w, x in zip(S.WEIGHTS, u[1], strict=True)), u[2])):
        dots = [sum(w * x * r for w, x, r in zip(S.WEIGHTS, v, room, strict=True)) for room in left]
        at = dots.index(max(dots))
        left[at] = [r - x for r, x in zip(left[at], v, strict=True)]
        got[k] = (at, ids)
    out = []
    for k in sorted(got):
        at, ids = got[k]
        for i in ids:
            out.append((i, k[2], k[1], at, slots[at]))
            slots[at] += 1
    return sorted(out, key=repr)


def collected(spark, rows, **how):
    df = spark.createDataFrame([(*r, *"x1234x1"[:1], 1, 2, "s", 3, 4, 5) for r in rows], SCHEMA).repartition(5)
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in S.place(df.select("doc_id", "text"), **how).collect()), key=repr)


@pytest.mark.parametrize(("n", "hot", "shards", "seed"), [(900, 0, 7, 1), (300, 400, 5, 2), (60, 0, 40, 3), (2500, 900, 3, 4)])
def test_against_brute_force(spark, n, hot, shards, seed):
    rows = rows_of(n, seed, hot)
    assert collected(spark, rows, shards=shards) == brute(rows, shards)


def test_many_tasks_keep_the_law(spark):
    rows = rows_of(4000, 5, 2500)
    got = collected(spark, rows, shards=6, per_task=300)
    assert Counter(r[:3] for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    load, count, slots, where = Counter(), Counter(), defaultdict(list), defaultdict(Counter)
    for _, size, crc, shard, slot in got:
        load[shard] += size
        count[shard] += 1
        slots[shard].append(slot)
        where[crc, size][shard] += 1
    assert set(load) == set(range(6)) and max(load.values()) < 1.02 * min(load.values()) and max(count.values()) < 1.05 * min(count.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    split = [k for k, v in where.items() if len(v) > 1]
    assert split == [(zlib.crc32(b"the same copied text"), 36)] and len(where[split[0]]) == 6
    assert got == collected(spark, rows[::-1], shards=6, per_task=300)


def test_query_and_empty(spark, tmp_path):
    rows = rows_of(200, 6)
    spark.createDataFrame([(*r, "x", 1, 2, "s", 3, 4, 5) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_sharding(spark, str(tmp_path))
    assert got.count() == len(rows) and {(r.law, r.grown_shard) for r in got.collect()} == {("bytes", None)} and {r.shard for r in got.collect()} == set(range(40))
    assert S.place(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    long = S.place(spark.createDataFrame([(1, "word " * 300_000), (2, None), (3, "x")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.size, r.tokens, r.slot) for r in long} == {(1, 1_500_016, 300_000, 0), (2, 16, 0, 0), (3, 17, 1, 0)} and len({r.shard for r in long}) == 3


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = rows_of(150, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.write_shards(df, f"{tmp_path}/shards", 4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    want = {(r.doc_id, r.size, r.shard, r.slot) for r in S.place(df, 4).collect()}
    assert {(r.doc_id, r.size, r.shard, r.slot) for r in got} == want
