import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from samewise.llm import mixing as M
from samewise.llm.q_mixing import OP9_SQL, op9_mixing
from samewise.operators.order import running
from tests.compare import compare


def brute_targets(sizes, ratio=1.5, weights=(5, 2, 1), passes=2):
    """Deal the total by weight, cap, and deal what is above to the others until nothing is."""
    keys = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(keys)}
    total, free, out = ratio * sum(sizes.values()), set(keys), {}
    while True:
        level = (total - sum(out.values())) / sum(w[s] for s in free) if free else 0
        above = {s for s in free if level * w[s] > passes * sizes[s]}
        if not above:
            return out | {s: level * w[s] for s in free}
        for s in above:
            out[s] = float(passes * sizes[s])
        free -= above


ROWS = [(i, " ".join(["w"] * (1 + i * 37 % 400)), f"s{i % 4}") for i in range(300)]
ROWS += [(1000 + i, "tiny text", "rare") for i in range(3)] + [(2000, None, "s0"), (2001, " \n", None), (2002, "a b c", None), (None, "x y", "s1"), (None, "x y", "s1"), (5, "dup id", "s2"), (3000, "w " * 30_000, "s3")]


@pytest.mark.parametrize("block", [16, 1024])
def test_mix(spark, block):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, source string, size int, rank int")
    placed, mixed = M.mix(df, block)
    got = M.taken(placed, mixed).collect()
    assert len(got) == len(ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    # the order of the mix: each block once, slots unique, every prefix near the shares
    slots = {(r.slot, r.sid, r["rank"]) for r in mixed.select("slot", "sid", "rank").distinct().collect()}
    assert len({x[0] for x in slots}) == len(slots) == len({x[1:] for x in slots})
    seen, share = Counter(), Counter(x[1] for x in slots)
    for n, (_, sid, rank) in enumerate(sorted(slots), 1):
        seen[sid] += 1
        assert all(abs(seen[k] - n * share[k] / len(slots)) <= 6 for k in share)
    again = M.taken(*M.mix(df.repartition(5), block)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    assert M.taken(*M.mix(df.where("false"))).count() == 0
    blank = M.taken(*M.mix(df.where("doc_id in (2000, 2001)"))).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2


def test_schedule_skips_and_appends(spark):
    quotas = spark.createDataFrame([(1, 5_000_000), (2, 1), (3, 0), (4, 70_000)], "sid int, quota long")
    got = M.schedule(quotas, 16)
    counts = {r.sid: (r.n, r.m) for r in got.groupBy("sid").agg(F.count("*").alias("n"), F.max("rank").alias("m")).collect()}
    assert counts == {1: (312_500, 312_499), 2: (1, 0), 4: (4375, 4374)}
    assert got.select("slot").distinct().count() == got.count()


def test_query_against_sql(spark, tmp_path):
    """op9 itself over written rows: a source with most rows, ties, nulls, many sources, empty texts."""
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 900)), "big") for i in range(700)] + [(2000 + i, "a b c", f"s{i % 90}") for i in range(200)] + ROWS
    rows += [(None, f"null id {i}", "big") for i in range(50)] + [(5000 + i, "", "blank") for i in range(5)]
    spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, slot int, target int, at int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    compare(spark, "op9", op9_mixing, OP9_SQL, str(tmp_path))
    got = op9_mixing(spark, str(tmp_path)).collect()
    assert len({r.first_slot for r in got}) > 100 and any(r.n_slots > 30 for r in got)


def test_running(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.randint(0, 5), rnd.randint(0, 9)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running(df, [F.col("k").asc_nulls_last(), F.col("i"), F.col("v")], {"before": F.col("v"), "at": F.lit(1)}).collect()
    total = 0
    for n, r in enumerate(sorted(got, key=lambda r: r["at"])):
        assert (r["at"], r.before) == (n, total)
        total += r.v
    order = [(r.k is None, r.k or "", r.i, r.v) for r in sorted(got, key=lambda r: r["at"])]
    assert order == sorted(order) and len(got) == 500
    assert running(df.where("false"), [F.col("i")], {"x": F.col("v")}).count() == 0
