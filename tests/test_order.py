import random

from pyspark.sql import functions as F

from samewise.operators.order import join_dealt, running


def rows_of(n):
    rnd = random.Random(n)
    return [(rnd.choice([1, 1, 1, 2, 3]) if i % 3 else i, rnd.randint(0, 5), rnd.randint(-9, 9)) for i in range(n)]


def test_sums_within_a_key(spark):
    rows = rows_of(4000)
    df = spark.createDataFrame(rows, "k long, i int, v int").repartition(7)
    order = [F.col("k"), F.col("i"), F.col("v")]
    got = running(df, order, {"at": F.lit(1), "pos": F.lit(1), "before": F.col("v")}, {"pos": "k", "before": "k"}).collect()
    assert len(got) == len(rows)
    last = None
    for n, r in enumerate(sorted(got, key=lambda r: r["at"])):
        if r.k != last:
            last, pos, total = r.k, 0, 0
        assert (r["at"], r.pos, r.before) == (n, pos, total)
        pos, total = pos + 1, total + r.v


def test_nulls_strings_and_empty(spark):
    rows = [(None, "b"), ("x", None), ("x", "a"), (None, None), ("", "c")] * 3
    df = spark.createDataFrame(rows, "k string, `odd name` string")
    got = sorted(running(df, [F.col("k").asc_nulls_last()], {"at": F.lit(1)}).collect(), key=lambda r: r["at"])
    assert [r["at"] for r in got] == list(range(15)) and [r.k for r in got] == [""] * 3 + ["x"] * 6 + [None] * 6
    assert running(df.where("false"), [F.col("k")], {"at": F.lit(1)}).count() == 0
    many = running(spark.range(50_000).withColumn("k", F.lit(1).cast("long")).repartition(9), [F.col("id")], {"pos": F.lit(1), "all": F.col("id")}, {"pos": "k"})
    assert many.where("pos <> id or all <> id * (id - 1) div 2").count() == 0


def test_join_of_many_rows_to_few_facts(spark):
    rows = [(None if i % 50 == 0 else f"k{max(0, i - 900)}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i int")
    facts = spark.createDataFrame([(f"k{i}", i * 2) for i in range(0, 120, 2)], "k string, v int")
    want = {(k, i, int(k[1:]) * 2 if k and int(k[1:]) % 2 == 0 else None) for k, i in rows}
    assert {tuple(r) for r in join_dealt(df, facts, "k", "left").collect()} == want
    assert {tuple(r) for r in join_dealt(df, facts, "k").collect()} == {r for r in want if r[2] is not None}
