import pytest

from samewise.plans.oracles import ORACLES
from samewise.plans.queries import QUERIES
from tests.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert {*ORACLES} <= {*QUERIES} <= {*entry.queries()}
    assert entry.entry(spark).count() == 200


def test_wratio_against_all_pairs(spark):
    from samewise.functions.scorers import wratio
    from samewise.plans.queries import THRESHOLDS

    names = sorted({r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()})
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if wratio(a, b) >= THRESHOLDS["WRatio"]}
    assert {(r.name_a, r.name_b) for r in QUERIES["wratio_pairs"](spark, SF).collect()} == want


def test_degree_cap_query(spark):
    pairs = sorted(((-r.similarity_score, r.name_a, r.name_b) for r in QUERIES["ratio_pairs"](spark, SF).collect()))
    used, want = {}, set()
    for _, a, b in pairs:
        if used.get(a, 0) < 2 and used.get(b, 0) < 2:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.add((a, b))
    assert {(r.name_a, r.name_b) for r in QUERIES["degree_capped_pairs"](spark, SF).collect()} == want
