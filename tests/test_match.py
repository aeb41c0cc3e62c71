import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from samewise.errors import DataValidationError, MatchingError
from samewise.functions import scorers as S
from samewise.functions.tiles import score_tiles
from samewise.operators import match as M
from samewise.operators.cap import degree_cap

ENTITIES = [("E1", "Apple Inc."), ("E2", "Apple Incorporated"), ("E3", "Microsoft Corporation"), ("E4", "Microsoft Corp"), ("E5", "Tesla Inc."), ("E6", None), ("E7", "  "), ("E8", "apple  INC.")]


@pytest.fixture
def entities(spark):
    return spark.createDataFrame(ENTITIES, "id string, name string")


def brute(rows, scorer, threshold, mult=1.0):
    f, out = S.scorer(scorer), {}
    rows = [(i, " ".join(n.split()).lower()) for i, n in rows if n is not None and n.strip()]
    for x, (i, a) in enumerate(rows):
        for j, b in rows[x + 1 :]:
            raw = f(a, b)
            got = float(np.float32(raw))
            if raw >= threshold and got and got * mult >= threshold:
                out[i, j] = got * mult
    return out


@pytest.mark.parametrize("scorer", ["ratio", "token_sort_ratio", "token_set_ratio", "partial_ratio", "WRatio", "jaro_winkler"])
def test_against_all_pairs(spark, scorer, monkeypatch):
    monkeypatch.setattr(M, "TILE", 7)
    rnd = random.Random(7)
    words = ["red", "green", "big", "small", "bolt", "bolts", "gear", "x", "widget"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))) for i in range(60)]
    t = 0.8 if scorer.startswith("jaro") else 75.0
    got = {(r.id1, r.id2): r.similarity_score for r in M.FuzzyMatcher(threshold=t, scorer=scorer).find_matches(spark.createDataFrame(rows, "id long, name string")).pairs.collect()}
    assert got == brute(rows, scorer, t)


def test_basics(spark, entities):
    found = M.FuzzyMatcher().find_matches(entities)
    assert {(r.id1, r.id2) for r in found.pairs.collect()} == {("E3", "E4"), ("E1", "E8")}  # 80.0 exactly, and equal names
    assert found.pairs.columns == ["id1", "id2", "name1", "name2", "similarity_score"]
    assert found.metadata["scorer"] == "token_sort_ratio"
    assert M.FuzzyMatcher().find_matches(entities.limit(0)).pairs.count() == 0
    assert M.FuzzyMatcher().find_matches(entities.where("id = 'E1'")).pairs.count() == 0
    with pytest.raises(DataValidationError):
        M.FuzzyMatcher().find_matches(entities, id_column="nope")
    with pytest.raises(MatchingError):
        M.FuzzyMatcher(scorer="nope")


def test_threshold_is_monotone_and_multiplier(entities):
    n = [M.FuzzyMatcher(threshold=t, scorer="ratio").find_matches(entities).pairs.count() for t in (50, 70, 90)]
    assert n[0] >= n[1] >= n[2]
    scaled = M.FuzzyMatcher(threshold=80, scorer="jaro", score_multiplier=100)
    assert scaled.find_matches(entities).pairs.count() == 0  # the cutoff is held against the raw score
    scaled.scale_cutoff = True
    assert scaled.find_matches(entities).pairs.count() > 0


def greedy(pairs, k):
    deg, out = {}, set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if deg.get(a, 0) < k and deg.get(b, 0) < k:
            deg[a] = deg.get(a, 0) + 1
            deg[b] = deg.get(b, 0) + 1
            out.add((a, b))
    return out


def test_degree_cap_equals_the_scan(spark):
    rnd = random.Random(11)
    for k in (1, 2, 3):
        edges = {(min(a, b), max(a, b)) for a, b in ((rnd.randrange(12), rnd.randrange(12)) for _ in range(40)) if a != b}
        pairs = [(a, b, float(rnd.randint(60, 70))) for a, b in edges]
        df = spark.createDataFrame(pairs, "id1 long, id2 long, similarity_score double")
        for finish in (0, 5, 20_000):
            got = {(r.id1, r.id2) for r in degree_cap(df, k, ["id1"], ["id2"], F.struct(-F.col("similarity_score"), "id1", "id2"), finish=finish).collect()}
            assert got == greedy(pairs, k)


def test_degree_cap_of_a_long_chain(spark):
    df = spark.range(1000).selectExpr("id AS a", "id + 1 AS b")
    got = {r.a for r in degree_cap(df, 1, ["a"], ["b"], F.struct("a")).collect()}
    assert got == set(range(0, 1000, 2))
    loops = spark.createDataFrame([("x", "x"), ("x", "y"), (None, "x"), ("x", "x")], "a string, b string")
    assert degree_cap(loops, 3, ["a"], ["b"], F.struct("a", "b")).count() == 2 and degree_cap(loops.limit(0), 3, ["a"], ["b"], F.struct("a")).count() == 0


def test_tiles_equal_the_scorers():
    rnd = random.Random(5)
    words = ["red", "green", "big", "small", "bolt", "bolts", "gear", "x", "widget", "supply", "supplies", "ltd", "a", "İz", "日本", "company", "global "]
    name = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(1, rnd.choice([2, 4, 16])))).strip()
    for round_ in range(4):
        a, b = sorted({name() for _ in range(60)}), sorted({name() for _ in range(50)})
        a, b = [*a, "bolt bolt"], [*b, "big bolts big x"]
        if round_ == 3:
            a, b = [*a, "", "q" * 300 + " red"], [*b, "", "q" * 290 + " red big", "z" * 70]
        for scorer in S.SCORERS:
            f = S.scorer(scorer)
            texts = [[" ".join(sorted(x.split())) for x in side] if scorer == "token_sort_ratio" else side for side in (a, b)]
            scores = {(i, j): f(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
            for cutoff in (0.7, 0.8, 0.95) if scorer.startswith("jaro") else (60, 75, 86):
                i, j, raw = score_tiles(scorer, *texts, cutoff, False)
                assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), raw.tolist(), strict=True)) == {k: v for k, v in scores.items() if v >= cutoff}, scorer


def test_ties_nulls_and_repeated_ids_pair(spark):
    rows = [(1, "red bolt", 5), (2, "red bolts", 5), (3, "red boltz", 5), (None, "red bolt", None), (1, "red bolt", 5), (1, "red bolt", 5)]
    df = spark.createDataFrame(rows, "id long, name string, at int")
    for order in ("at", None, "name"):
        got = M.FuzzyMatcher(threshold=80, scorer="ratio").find_matches(df, order_by=order).pairs.collect()
        assert len(got) == 15  # every pair of the six rows
    capped = M.FuzzyMatcher(threshold=80, scorer="ratio", max_matches_per_entity=1).find_matches(df, order_by="at").pairs.collect()
    assert len(capped) == 3


def test_cross(spark):
    left = spark.createDataFrame([("C1", "Apple Inc", "Apl"), ("C2", "Microsoft Corp", None), ("C3", "Nothing", "Here")], "cid string, name string, short string")
    right = spark.createDataFrame([("E1", "apple inc"), ("E2", "Microsoft Corporation"), ("E3", "apl")], "eid string, title string")
    one = M.FuzzyMatcher(threshold=80).find_cross_matches(left, right, "cid", "eid", "name", "title")
    assert {(r.id1, r.id2, r.matched_column1, r.source2) for r in one.pairs.collect()} == {("C1", "E1", "name", "df2"), ("C2", "E2", "name", "df2")}
    many = M.FuzzyMatcher(threshold=80).find_cross_matches(left, right, "cid", "eid", ["name", "short", "absent"], ["title"])
    assert {(r.id1, r.id2, r.matched_column1) for r in many.pairs.collect()} == {("C1", "E1", "name"), ("C2", "E2", "name"), ("C1", "E3", "short")}
    assert many.metadata["total_combinations_tried"] == 3
    assert M.FuzzyMatcher().find_cross_matches(left.limit(0), right, "cid", "eid", "name", "title").pairs.count() == 0


@pytest.mark.parametrize("scorer", sorted(S.SCORERS))
def test_blocks_of_longer_lists_equal_the_scorers(scorer, monkeypatch):
    from samewise.functions import tiles as T

    monkeypatch.setattr(T, "BLOCK", 16)
    monkeypatch.setattr(T, "TOKENS", 3)
    monkeypatch.setattr(T, "DEPTH", 2)
    rnd = random.Random(scorer)
    words = ["red", "bolt", "bolts", "aaaaaaa", "aabaaa", "supply", "supplies", "ab", "ba", "ééé", "x  y", "bolt bolt"]
    a = sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, rnd.choice([2, 3, 9])))) for _ in range(90)}, key=len)
    if scorer == "token_sort_ratio":
        a = [" ".join(sorted(x.split())) for x in a]
    f = S.scorer(scorer)
    scores = {(i, j): f(x, y) for i, x in enumerate(a) for j, y in enumerate(a) if i < j}
    for cutoff in (0.0, 0.75, 0.92) if scorer.startswith("jaro") else (0.0, 55, 70, 86, 96):
        i, j, raw = score_tiles(scorer, a, a, cutoff, True)
        assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), raw.tolist(), strict=True)) == {k: v for k, v in scores.items() if v >= cutoff}, cutoff


@pytest.mark.parametrize("scorer", ["ratio", "token_sort_ratio"])
def test_segments_find_what_the_grid_finds(spark, scorer):
    rnd = random.Random(21)
    words = ["red", "green", "big", "small", "bolt", "bolts", "gear", "widget", "supply", "supplies", "company", "limited"]
    names = {" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 5))) for _ in range(250)}
    for n in sorted(names)[:120]:  # with insertions, deletions and exchanges
        for _ in range(2):
            t = list(n)
            for _ in range(rnd.randint(1, 4)):
                at = rnd.randrange(len(t))
                t[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "e"])
            names.add(" ".join("".join(t).split()))
    f = S.scorer(scorer)
    names = sorted(n for n in names if len(n) > 6)
    scores = {(a, b): f(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    odd, even = names[1::2], names[::2]
    halves = [spark.createDataFrame([(n,) for n in side], "name string") for side in (odd, even)]
    for cutoff in (82.0, 93.5, 100.0) if scorer == "ratio" else (88.0, 97.0):
        want = {frozenset(k) for k, v in scores.items() if v >= cutoff}
        for method in ("segments", "grid"):
            rows = M.name_pairs(df, None, scorer, cutoff, method=method).collect()
            assert {frozenset((r.name_a, r.name_b)) for r in rows} == want and len(rows) == len(want), (method, cutoff)
        crossed = {(r.name_a, r.name_b) for r in M.name_pairs(*halves, scorer, cutoff, method="segments").collect()}
        assert crossed == {(a, b) for a in odd for b in even if scores.get((a, b), scores.get((b, a))) >= cutoff}


def test_choice_of_method(spark, monkeypatch):
    names = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("name")).withColumn("name", F.substring("name", 1, 24))
    near = names.union(names.limit(40).select(F.concat(F.substring("name", 1, 11), F.lit("?"), F.substring("name", 12, 13))))
    want = sorted(map(tuple, M.name_pairs(near, None, "ratio", 90.0, method="grid").select(F.least("name_a", "name_b"), F.greatest("name_a", "name_b"), "similarity_score").collect()))
    assert len(want) == 40
    monkeypatch.setattr(M, "MANY", 1000)
    taken = []
    monkeypatch.setattr(M.SegmentJoin, "pairs", lambda self, *a, f=M.SegmentJoin.pairs: taken.append(1) or f(self, *a))
    got = M.name_pairs(near, None, "ratio", 90.0)
    assert sorted(map(tuple, got.select(F.least("name_a", "name_b"), F.greatest("name_a", "name_b"), "similarity_score").collect())) == want and taken == [1]
    same = spark.range(300).select(F.format_string("customer number %09d", "id").alias("name"))  # every segment but one is everywhere
    assert M.name_pairs(same, None, "ratio", 96.0).count() > 300 and taken == [1]
    with pytest.raises(Exception, match="segments"):
        M.name_pairs(near, None, "jaro", 0.9, method="segments")
    assert M.name_pairs(near.limit(0), None, "ratio", 90.0, method="segments").count() == 0


def test_degree_cap_of_chains_beyond_one_task(spark):
    """100,000 chained pairs without the scan by one task; then chains for every cap, and chains that branch."""
    import time

    start = time.time()
    df = spark.range(100_000).selectExpr("id AS a", "id + 1 AS b")
    got = degree_cap(df, 1, ["a"], ["b"], F.struct("a"), finish=0)
    assert got.where("a % 2 = 1").isEmpty() and got.count() == 50_000
    assert time.time() - start < 120
    rnd = random.Random(8)
    for k in (1, 2):
        edges = [(i, i + 1) for i in range(0, 120)] + [(500 + i, i) for i in range(0, 120, 7)] + [(i, i + rnd.randint(2, 5)) for i in range(0, 120, 11)]
        pairs = [(a, b, float(1000 - min(a, b) if a < 500 else rnd.randint(800, 1000))) for a, b in dict.fromkeys(edges)]
        df = spark.createDataFrame(pairs, "id1 long, id2 long, similarity_score double")
        got = {(r.id1, r.id2) for r in degree_cap(df, k, ["id1"], ["id2"], F.struct(-F.col("similarity_score"), "id1", "id2"), finish=0).collect()}
        assert got == greedy(pairs, k)


def test_names_that_differ_by_case_only_raise(spark):
    df = spark.sql("SELECT 1 AS id, 'a' AS name, 'b' AS Name")
    for run in (lambda m: m.find_matches(df), lambda m: m.find_cross_matches(df, df)):
        with pytest.raises(DataValidationError, match="2 columns"):
            run(M.FuzzyMatcher())


def test_facts_are_observed_by_the_jobs_that_write(spark, entities):
    found = M.FuzzyMatcher(batch_size=4).find_matches(entities)
    assert (found.metadata["total_entities"], found.metadata["batches_processed"]) == (6, 2) and "matches_found" not in found.metadata
    stored = found.stored()
    assert stored.metadata == {**found.metadata, "matches_found": 2} and stored.pairs.count() == 2
    assert stored.counts().first().asDict() == found.counts().first().asDict() == {"total_entities": 6, "matches_found": 2}
    for few in (entities.limit(0), entities.where("id in ('E1', 'E6', 'E7')")):
        none = M.FuzzyMatcher().find_matches(few).stored()
        assert none.metadata["matches_found"] == 0 and none.metadata["message"] and none.pairs.count() == 0
    right = spark.createDataFrame([("R1", "apple inc.", None), ("R2", None, "tesla inc."), ("R3", None, None)], "rid string, title string, other string")
    one = M.FuzzyMatcher().find_cross_matches(entities, right, "id", "rid", "name", "title").stored().metadata
    assert [one[k] for k in ("df1_entities", "df2_entities", "cross_matches_found", "matching_type")] == [6, 1, 2, "cross_dataset"]
    many = M.FuzzyMatcher().find_cross_matches(entities, right, "id", "rid", ["name"], ["title", "other", "absent"]).stored().metadata
    assert [many[k] for k in ("df1_entities", "df2_entities", "cross_matches_found", "total_combinations_tried")] == [8, 3, 3, 3]
    empty = M.FuzzyMatcher().find_cross_matches(entities, right.limit(0), "id", "rid", ["name"], ["title", "other"]).stored()
    assert empty.metadata["cross_matches_found"] == empty.metadata["df2_entities"] == empty.pairs.count() == 0 and empty.metadata["message"]


def test_names_of_many_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(M, "DEAL", 3)
    rows = [(i, "red bolt" if i % 3 else "red bolts" if i % 2 else f"gear {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, name string")
    got = {(r.id1, r.id2): r.similarity_score for r in M.FuzzyMatcher(threshold=80, scorer="ratio").find_matches(df).pairs.collect()}
    assert got == brute(rows, "ratio", 80.0)
    cross = M.FuzzyMatcher(threshold=80, scorer="ratio").find_cross_matches(df, df).pairs.collect()
    want = {(i, i) for i, _ in rows} | {*got} | {(j, i) for i, j in got}
    assert {(r.id1, r.id2) for r in cross} == want and len(cross) == len(want)


def test_pairs_of_many_equal_names_are_counted_without_expanding_them(spark):
    # 60,000 rows of two linked names: 1.8 thousand million pairs, which would not be counted one by one in a test
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, "large ring").otherwise("large rings").alias("name"))
    found = M.FuzzyMatcher(threshold=80, scorer="ratio").find_matches(rows)
    assert found.counts().first().matches_found == found.counted().metadata["matches_found"] == 60_000 * 59_999 // 2
    few = rows.where("id < 40")
    found = M.FuzzyMatcher(threshold=99, scorer="ratio").find_matches(few)
    assert found.count() == found.pairs.count() == 14 * 13 // 2 + 26 * 25 // 2
    cross = M.FuzzyMatcher(threshold=80, scorer="ratio").find_cross_matches(few, few.limit(7))
    assert cross.counted().metadata["cross_matches_found"] == cross.pairs.count() == 280


def test_many_rows_that_match_one_name_are_the_work_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(M, "DEAL", 4)
    monkeypatch.setitem(M.FuzzyMatcher.find_cross_matches.__globals__, "spread", lambda df, *keys: df.repartition(8, *keys))
    left = spark.range(400).select("id", F.lit("large ring").alias("name"), F.lit("STEEL").alias("kind"))
    right = spark.createDataFrame([(1, "large rings", "STEEL"), (2, "gear", "STEEL")], "id long, name string, kind string")
    found = M.FuzzyMatcher(threshold=80, scorer="ratio").find_cross_matches(left, right).pairs
    per = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 400 and max(per) < 200
    best = M.FuzzyMatcher(threshold=80, scorer="ratio").find_cross_matches(left, right, name_columns1=["name", "kind"], name_columns2=["name", "kind"]).pairs.collect()
    assert {(r.id1, r.id2, r.matched_column1) for r in best} == {(i, j, "kind") for i in range(400) for j in (1, 2)} and len(best) == 800


def test_copies_of_rows_for_cells_grow_with_rows_not_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "DEAL", 4)
    monkeypatch.setattr(M, "CELLS", 8, raising=False)
    copies = []
    monkeypatch.setattr(M, "spread", lambda df, *keys: copies.append(df) or df)
    for n in (100, 400):
        rows = [(i, "large ring" if i % 2 else "large rings" if i < n // 2 else "gear") for i in range(n)]
        got = [(r.id1, r.id2) for r in M.FuzzyMatcher(threshold=80, scorer="ratio").find_matches(spark.createDataFrame(rows, "id long, name string")).pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == {*brute(rows, "ratio", 80.0)}
        assert copies[-1].count() <= 8 * n  # 1,675 of the first 100 rows when deals did not grow and met in both orders


def test_pairs_are_expanded_when_asked_for(spark, monkeypatch):
    asked, real = [], M.expand_classes
    monkeypatch.setattr(M, "expand_classes", lambda *a: asked.append(1) or real(*a))
    found = M.FuzzyMatcher(threshold=80, scorer="ratio").find_matches(spark.range(30).select("id", F.lit("large ring").alias("name")))
    assert found.counts().first().matches_found == 435 and not asked
    assert found.pairs.count() == found.stored().pairs.count() == 435 and len(asked) == 1
