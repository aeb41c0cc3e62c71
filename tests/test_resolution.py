import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samewise.cli import main
from samewise.errors import ConfigurationError, DataValidationError
from samewise.operators import consolidate as C
from samewise.operators import groups as G
from samewise.operators import inputs as I
from samewise.operators import judge as J
from samewise.operators import pairs as P
from samewise.operators.components import connected_components
from samewise.operators.match import FuzzyMatcher
from samewise.operators.rules import PASSED, RuleBasedValidator
from samewise.plans import resolve as R

ROWS = [("E1", "Apple Inc.", "US"), ("E2", "Apple Inc", "US"), ("E3", "Microsoft Corporation", "US"), ("E4", "Microsoft Corp", "DE"), ("E5", "Tesla Inc.", "US"), ("E6", None, None)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "id string, name string, country string")


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)] + [(i, i + 1) for i in range(20, 60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5, **{i: 20 for i in range(20, 61)}}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_symmetric(spark):
    pairs = spark.createDataFrame([("A", "B", 90.0), ("B", "A", 90.0), ("A", "C", 80.0)], "id1 string, id2 string, similarity_score double")
    assert P.remove_symmetric(pairs).count() == 2


def test_pipeline(spark, df, tmp_path):
    pipe = R.DeduplicationPipeline(FuzzyMatcher(threshold=80), RuleBasedValidator(80, {"country": {"operator": "exact"}}), True, str(tmp_path / "cp"))
    result = pipe.run(df)
    groups = {r.entity_id: r.group_id for r in result.entity_groups.collect()}
    assert groups == {"E1": 1, "E2": 1, "E3": 0, "E4": 0, "E5": 0, "E6": 0}
    stats = result.statistics.first().asDict()
    assert stats["total_entities"] == 6 and stats["duplicate_pairs"] == 1 and stats["singleton_entities"] == 4
    again = pipe.run(df)
    assert {r.entity_id: r.group_id for r in again.entity_groups.collect()} == groups
    assert [r.entity_id for r in result.get_group("E3").collect()] == ["E3"]
    assert sorted(r.entity_id for r in result.get_group("E1").collect()) == ["E1", "E2"]
    assert result.get_group("none").count() == 0
    for strategy, kept in (("first", "E1"), ("last", "E2"), ("highest_score", "E1")):
        ids = {r.id for r in result.remove_duplicates(df, strategy=strategy).collect()}
        assert ids == {kept, "E3", "E4", "E5", "E6"}
    summary = result.get_removal_summary(result.remove_duplicates(df)).first()
    assert summary.duplicates_removed == 1 and summary.removal_rate == pytest.approx(100 / 6)
    R.save_dedup(result, str(tmp_path / "out"))
    loaded = R.load_dedup(spark, str(tmp_path / "out"))
    assert loaded.entity_groups.count() == 6 and loaded.statistics.first()["duplicate_pairs"] == 1
    with pytest.raises(DataValidationError):
        pipe.run(df, id_column="nope")
    with pytest.raises(ConfigurationError):
        R.DeduplicationPipeline(FuzzyMatcher(), checkpoint=True, checkpoint_dir=str(tmp_path), checkpoint_type="x").run(df)


def test_run_by_name_equals_run(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["red bolt", "bolt red", "red bolts", "gear", "gear", "x", None, ""])], "id long, name string")
    pipe = R.DeduplicationPipeline(FuzzyMatcher(threshold=80))
    a = {r.entity_id: r.group_id for r in pipe.run(rows).entity_groups.collect()}
    b = {r.entity_id: r.group_id for r in pipe.run_by_name(rows).collect()}
    assert a == b == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 0, 6: 0, 7: 0}


def test_rules(spark):
    ents = spark.createDataFrame([("A", "US", "100", "shop"), ("A", "XX", "1", "late"), ("B", "US", "150", "shops"), ("C", "DE", "x", None), ("D", None, "101", "zzz")], "id string, country string, size string, kind string")
    pairs = spark.createDataFrame([("A", "B", 95.0), ("A", "C", 95.0), ("A", "D", 85.0), ("A", "Q", 95.0)], "id1 string, id2 string, similarity_score double")
    v = RuleBasedValidator(90, {"country": {}, "size": {"operator": "inequality", "max_diff_percent": 20}, "kind": {"operator": "fuzzy"}, "absent": {}, "country2": {"operator": "odd"}})
    got = {r.id2: (r.keep, r.validation_reason) for r in v.validate(pairs, ents.coalesce(1)).annotated.collect()}
    assert got["Q"] == (True, PASSED)
    assert got["B"] == (False, "size difference 33.3% > 20%")
    assert got["C"] == (False, "country differs: US vs DE")
    assert got["D"][1].startswith("Score 85.0 < threshold 90; kind similarity")
    custom = RuleBasedValidator(0, custom_rules={"same_country": F.col("country_1") == F.col("country_2")})
    assert {r.id2 for r in custom.validate(pairs, ents).removed_pairs.collect()} == {"C"}


def test_cross_and_consolidation(spark):
    left = spark.createDataFrame([("C1", "Apple Inc"), ("C2", "Microsoft Corp"), ("C3", "Other"), ("C1", "again")], "id string, name string")
    right = spark.createDataFrame([("E1", "Apple Inc", "low"), ("E2", "Apple Inc.", "high"), ("E3", "Microsoft Corporation", None)], "eid string, name string, tier string")
    result = R.DeduplicationPipeline(FuzzyMatcher(threshold=80)).run_cross_dataset(left, right, "id", "eid")
    stats = result.statistics.first()
    assert (stats.df1_total, stats.cross_matches, stats.df2_unmatched) == (4, 3, 0)
    assert result.get_df1_matches("C1").count() == 2 and result.get_df2_matches("E3").count() == 1
    merged = result.merge_datasets(left.where("name <> 'again'"), right)
    assert merged.count() == 3 and {"name_1", "name_2", "df1_id"} <= {*merged.columns}
    on = lambda **k: {r.id: r for r in C.consolidate(result.cross_matches, left, right, "id", "eid", C.ConsolidationConfig(enabled=True, **k)).collect()}
    best = on()
    assert best["C1"].main_eid == "E1" and best["C1"].other_candidates == "E2" and best["C1"].all_match_ids == "E1, E2" and best["C3"].total_matches == 0 and best["C3"].main_eid is None
    tier = {"priority_column": "tier", "priority_order": ["high", "low"]}
    assert on(**tier)["C1"].main_eid == "E2" and on(**tier)["C1"].main_tier == "high"
    assert on(**tier, priority_mode="threshold", priority_threshold=1)["C1"].main_eid == "E1"
    assert on(**tier, priority_mode="threshold", priority_threshold=20)["C1"].main_eid == "E2"
    assert on(filter_function=F.col("df2_id") != "E1")["C1"].main_eid == "E2"
    assert on(selection_function=lambda g: g.sort_values("df2_id").iloc[-1])["C1"].main_eid == "E2"
    assert C.consolidate(result.cross_matches, left, right, "id", "eid", C.ConsolidationConfig()).count() == 4
    assert {"main_eid", "main_name"} <= {*result.consolidate(left, right, C.ConsolidationConfig(enabled=True)).columns}
    with pytest.raises(ConfigurationError):
        on(**tier, priority_mode="odd")


def test_selected_rows_over_batches():
    ids = [1, 1, 1, 2, None, None, 3]
    table = pa.table({"df1_id": pa.array(ids, pa.int64()), "v": pa.array([5, 2**60 + 1, None, 1, 4, 9, 0], pa.int64())})
    for size in (1, 2, 3, 7):
        batches = [*table.to_batches(max_chunksize=size), *table.slice(0, 0).to_batches()]
        got = pa.Table.from_batches(C._selected(lambda g: g.sort_values("v").iloc[-1] if g.v.notna().all() else g.iloc[1])(iter(batches)))
        assert got.drop_columns("_rn").equals(table) and got["_rn"].to_pylist() == [2, 1, 2, 1, 2, 1, 1]
    assert [*C._selected(lambda g: g.iloc[0])(iter(()))] == []


def test_selection_converts_rows_together_not_one_by_one():
    import time

    n = 2000
    table = pa.table({"df1_id": range(n), "name": ["a"] * n, "df2_id": range(n), "score": [90.0] * n, "reason": ["b"] * n})
    start = time.perf_counter()
    for i in range(n):
        table.slice(i, 1).to_pandas()
    alone, start = time.perf_counter() - start, time.perf_counter()
    got = pa.Table.from_batches(C._selected(lambda g: g.iloc[0])(iter(table.to_batches())))
    assert got["_rn"].to_pylist() == [1] * n and time.perf_counter() - start < 0.7 * alone


def test_selection_sees_the_types_of_its_rows_alone():
    table = pa.table({"df1_id": [1, 1, 2, 3], "v": pa.array([2**60 + 1, 3, None, 4], pa.int64()), "b": pa.array([True, False, None, True]), "l": pa.array([[2**60 + 1], [2], [None], [3]], pa.list_(pa.int64()))})
    starts = [0, 2, 3, 4]
    for got, i, j in zip(C._frames(table, starts), starts, starts[1:], strict=False):
        pd.testing.assert_frame_equal(got, table.slice(i, j - i).to_pandas())
        got["v"] = 0  # a frame of its own, which may be written to


def _judge(reply):
    return lambda: (lambda prompt: reply)


def test_judge(spark, df):
    pairs = FuzzyMatcher(threshold=80).find_matches(df).pairs.coalesce(1).orderBy("id1")
    said = '```json\n{"decisions": [{"pair_index": 0, "is_duplicate": "false", "reason": "no"}, {"pair_index": 99, "is_duplicate": false}]}\n```'
    out = J.LLMValidator(_judge(said), n_workers=1, metadata_columns=["country"]).validate(pairs, df)
    assert sorted(r.validation_reason for r in out.annotated.collect()) == [J.KEPT_BY_DEFAULT, "no"] and out.removed_pairs.count() == 1
    bad = J.LLMValidator(_judge("no json"), max_retries=2, pause=0.0).validate(pairs, df)
    assert {r.validation_reason for r in bad.annotated.collect()} == {J.KEPT_ON_FAILURE}
    resumed = J.LLMValidator(_judge("no json"), max_retries=1).validate(pairs, df, decided=out.annotated)
    assert resumed.removed_pairs.count() == 1
    matches = spark.createDataFrame([("C1", "a", "E1", "x", 90.0), ("C1", "a", "E2", "y", 95.0), ("C2", "b", "E1", "x", 80.0)], "df1_id string, df1_name string, df2_id string, df2_name string, similarity_score double")
    left = spark.createDataFrame([("C1", "a"), ("C2", "b"), ("C3", "c")], "id string, name string")
    got = {r.id: r for r in J.consolidate_by_judge(matches, left, "id", _judge('{"selections": [{"entity_id": "C1", "selected_candidate_id": "E1", "reasoning": "r"}]}'), "eid").collect()}
    assert got["C1"].main_eid == "E1" and got["C1"].total_matches == 2 and got["C2"].total_matches == 0 and got["C3"].main_eid is None
    failed = {r.id: r for r in J.consolidate_by_judge(matches, left, "id", _judge("?"), "eid", max_retries=1).collect()}
    assert failed["C1"].main_eid == "E2"
    off = J.consolidate_by_judge(matches, left, "id", _judge("?"), "eid", enabled=False).collect()
    assert {r.total_matches for r in off} == {0} and {r.main_eid for r in off} == {None}
    earlier = spark.createDataFrame([("C1", "E1", "x", 90.0, "before", 2)], "_of string, main_eid string, main_name string, main_similarity_score double, llm_reasoning string, total_matches long")
    resumed = {r.id: r for r in J.consolidate_by_judge(matches, left, "id", _judge("?"), "eid", max_retries=1, decided=earlier).collect()}
    assert resumed["C1"].llm_reasoning == "before" and resumed["C2"].main_eid == "E1"
    told = []
    prompt = J.candidate_prompt([{"df1_id": "C1", "df1_name": "a", "candidates": [{"df2_id": "E1", "df2_name": "x", "similarity_score": 90.0, "facts": {"tier": "high", "size": None}}]}])
    assert "tier: high; size: N/A" in prompt and not told
    right = spark.createDataFrame([("E1", "high"), ("E2", "low")], "eid string, tier string")
    pick = lambda: (lambda p: '{"selections": [{"entity_id": "C1", "selected_candidate_index": %d}]}' % (0 if "tier: low" in p else 1))
    rich = {r.id: r for r in J.consolidate_by_judge(matches, left, "id", pick, "eid", df2=right, df2_key="eid", metadata_columns=("tier", "absent")).collect()}
    assert rich["C1"].main_eid == "E2" and rich["C1"].other_candidates == "E1" and rich["C3"].other_candidates is None


def test_answers_of_the_judge_leave_by_the_batch(spark, monkeypatch):
    frame = pd.DataFrame({"_pair": [str(i) for i in range(25)], "name1": "a", "name2": "b", "similarity_score": 90.0})
    said = _judge('{"decisions": [{"pair_index": 0, "is_duplicate": false, "reason": "no"}]}')
    (out,) = J.LLMValidator(said, batch_size=10)._judge()(iter([frame]))
    assert [*out._pair] == [*frame._pair] and [i for i, f in enumerate(out._first) if f] == [0, 10, 20] == [i for i, k in enumerate(out.keep) if not k]
    seen = {}
    monkeypatch.setattr(J, "_answers", lambda todo, key, run, *more, **how: seen.update(todo=todo, run=run) or (todo.select(F.col("df1_id").alias("_of"), F.lit(1).cast("long").alias("total_matches")), 0, 0))
    matches = spark.createDataFrame([(i, "a", 1, "x", 90.0) for i in range(12)], "df1_id long, df1_name string, df2_id long, df2_name string, similarity_score double")
    J.consolidate_by_judge(matches, spark.range(12), "id", _judge('{"selections": []}'))
    (got,) = seen["run"](iter(seen["todo"].coalesce(1).toArrow().combine_chunks().to_batches()))
    assert got.num_rows == 12 and sum(got["_first"].to_pylist()) == 3


def test_judge_is_told_whole_ids_beside_a_null(spark):
    matches = spark.createDataFrame([(1, "a", 5, "x", 90.0), (None, "b", 6, "y", 95.0)], "df1_id long, df1_name string, df2_id long, df2_name string, similarity_score double").coalesce(1)
    said = _judge('{"selections": [{"entity_id": 1, "selected_candidate_id": 5}]}')
    got = J.consolidate_by_judge(matches, spark.range(1, 2), "id", said, n_workers=1).first()
    assert got.main_df2_id == "5" and got.total_matches == 1


class Counting:
    """A client that notes its prompts in a folder and fails where a marker is set."""

    version = "1"

    def __init__(self, folder, fails=""):
        self.folder, self.fails = str(folder), fails

    def __call__(self):
        import os
        import uuid

        def client(prompt):
            if self.fails and os.path.exists(self.fails) and len(os.listdir(self.folder)) >= 2:
                os._exit(1)  # the worker is lost, not the call
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return '{"decisions": [{"pair_index": 0, "is_duplicate": false, "reason": "no"}]}'

        return client


def test_judge_is_taken_up_where_it_broke_off(spark, tmp_path):
    import os

    rows = spark.createDataFrame([(f"E{i}", f"Company number {i:02}", "US") for i in range(6)], "id string, name string, country string")
    asked, marker = tmp_path / "asked", tmp_path / "fail"
    asked.mkdir()
    marker.write_text("")
    judge = J.LLMValidator(Counting(asked, str(marker)), batch_size=1, n_workers=1, metadata_columns=["country"], progress_groups=15)
    pipe = R.DeduplicationPipeline(FuzzyMatcher(threshold=80), judge, True, str(tmp_path / "cp"))
    with pytest.raises(Exception):  # noqa: B017
        pipe.run(rows)
    before = len(os.listdir(asked))
    assert before >= 2
    marker.unlink()
    result = pipe.run(rows)
    assert result.duplicate_pairs.count() == 0
    n = FuzzyMatcher(threshold=80).find_matches(rows).pairs.count()
    prompts = [f.read_text() for f in asked.iterdir()]
    assert n == 15 and len(prompts) <= n + 1 and len(set(prompts)) == n  # at most the batch that broke off is asked again
    assert pipe.run(rows).duplicate_pairs.count() == 0 and len(os.listdir(asked)) == len(prompts)


def test_judge_of_two_tables(spark, tmp_path):
    left = spark.createDataFrame([("C1", "Apple Inc", "US"), ("C2", "Microsoft Corp", "US")], "id string, name string, country string")
    right = spark.createDataFrame([("E1", "Apple Inc.", "DE"), ("E2", "Microsoft Corporation", None)], "eid string, name string, country string")
    asked = tmp_path / "asked"
    asked.mkdir()
    judge = J.LLMValidator(Counting(asked), batch_size=1, n_workers=1, metadata_columns=["country"])
    pipe = R.DeduplicationPipeline(FuzzyMatcher(threshold=80), judge, True, str(tmp_path / "cp"))
    assert pipe.run_cross_dataset(left, right, "id", "eid").cross_matches.count() == 0
    assert sorted(x.read_text().split("(")[1].split(")")[0] for x in asked.iterdir()) == ["country: US vs DE", "country: US vs N/A"]
    assert pipe.run_cross_dataset(left, right, "id", "eid").cross_matches.count() == 0 and len(list(asked.iterdir())) == 2
    assert pipe.run_cross_dataset(left, right, "id", "eid", resume=False).cross_matches.count() == 0


def test_checkpoint_keys_hold_all_settings():
    judge = lambda **how: R._settings(J.LLMValidator(_judge("x"), **how))
    assert judge() == judge() != judge(instructions="other") and judge() == judge(progress="elsewhere")
    rules = lambda f: R._settings(RuleBasedValidator(90, custom_rules={"r": f}))
    assert rules(lambda: F.col("a") > 1) == rules(lambda: F.col("a") > 1) != rules(lambda: F.col("a") > 2)
    assert R._settings(J.LLMValidator(_judge("x"))) != R._settings(J.LLMValidator(_judge("y")))
    assert R._settings(FuzzyMatcher()) != R._settings(FuzzyMatcher(threshold=81))


def test_names_that_clash(spark, df):
    with pytest.raises(DataValidationError):
        R.DeduplicationPipeline(FuzzyMatcher()).run(df.withColumn("key", F.col("id")), id_column="key")
    swapped = df.select(F.col("id").alias("name"), F.col("name").alias("id"))
    assert R.DeduplicationPipeline(FuzzyMatcher(threshold=80)).run(swapped, id_column="name", name_column="id").duplicate_pairs.count() == 2


def test_inputs(spark):
    raw = spark.createDataFrame([("1", " a "), ("2", None), ("3", "  "), (None, "x"), ("1", "b"), ("4", "y" * 10_001)], "id string, name string")
    checked = I.validate_deduplication_input(raw)
    assert sorted(r.name for r in checked.valid.collect()) == ["a", "b"]
    assert sorted(r.reject_reason for r in checked.rejected.collect()) == ["id is empty", "name is empty", "name is empty", "name is too long"]
    assert any("repeat" in w for w in checked.warnings)
    with pytest.raises(DataValidationError):
        I.validate_structure(raw, ["absent"])
    with pytest.raises(DataValidationError):
        I.validate_structure(raw, ["name"], null_policy="strict")
    with pytest.raises(DataValidationError):
        I.validate_deduplication_input(raw.limit(1))
    with pytest.raises(DataValidationError):
        I.validate_deduplication_input(raw, threshold=101)
    assert I.DeduplicationInput(additional_columns=[" name", "name "]).additional_columns == ["name"]
    assert [c.metadata["final_row_count"] for c in I.CrossDatasetInput().check(raw, raw)] == [2, 2]
    with pytest.raises(DataValidationError):
        I.CrossDatasetInput(name_columns1=["absent"]).check(raw, raw)
    with pytest.raises(DataValidationError):
        I.DeduplicationInput(threshold=-1)
    assert I.quality_score(raw.limit(0)).first()[0] == 0.0
    assert I.quality_score(spark.createDataFrame([("1", "a"), ("2", "b")], "id string, name string")).first()[0] == pytest.approx(1.0)
    assert G.statistics(spark.createDataFrame([], R.GROUPS)).first().total_entities == 0


def test_cli(spark, tmp_path, capsys, monkeypatch):
    pd.DataFrame(ROWS, columns=["id", "name", "country"]).to_csv(tmp_path / "in.csv", index=False)
    monkeypatch.chdir(tmp_path)  # the sample configuration keeps checkpoints in the working folder
    main(["init", "-o", str(tmp_path / "c.json")], spark)
    args = ["run", "-i", str(tmp_path / "in.csv"), "-o", str(tmp_path / "out"), "-c", str(tmp_path / "c.json"), "--threshold", "80", "--validate", "--validator", "none", "--verbose"]
    assert main(args, spark) == 0
    assert main(["analyze", str(tmp_path / "out"), "--format", "json"], spark) == 0
    assert main(["show-group", str(tmp_path / "out"), "E1"], spark) == 0
    assert "E2" in capsys.readouterr().out
    assert main(["remove", "-i", str(tmp_path / "in.csv"), "-r", str(tmp_path / "out"), "-o", str(tmp_path / "clean.parquet")], spark) == 0
    assert spark.read.parquet(str(tmp_path / "clean.parquet")).count() == 4
    assert main(["cross-match", "-i", str(tmp_path / "in.csv"), "--input2", str(tmp_path / "in.csv"), "-o", str(tmp_path / "x"), "--threshold", "99"], spark) == 0
    assert R.load_cross(spark, str(tmp_path / "x")).cross_matches.count() == 5


def test_rows_without_id_survive(spark):
    rows = spark.createDataFrame([(1, "acme"), (2, "acme"), (None, "zeta"), (3, "solo"), (None, "acme")], "id long, name string")
    result = R.DeduplicationPipeline(FuzzyMatcher(threshold=90), None).run(rows)
    for strategy in ("first", "last", "highest_score"):
        got = sorted((r.name, r.id or 0) for r in result.remove_duplicates(rows, strategy=strategy).collect())
        assert ("zeta", 0) in got and ("solo", 3) in got and ("acme", 0) in got, strategy


def test_two_rows_of_one_id_pair_get_their_own_decisions(spark):
    pairs = spark.createDataFrame([(1, 2, "a", "b", 90.0), (1, 2, "a", "c", 95.0), (None, 2, None, "b", 80.0), (1, 2, "a", "c", 95.0)], "id1 long, id2 long, name1 string, name2 string, similarity_score double")
    entities = spark.createDataFrame([(1, "x"), (2, "y")], "id long, name string")
    client = lambda: (lambda p: '{"decisions": [{"pair_index": 0, "is_duplicate": %s, "reason": "said"}]}' % ("false" if "'c'" in p else "true"))
    out = J.LLMValidator(client, batch_size=1).validate(pairs, entities)
    assert sorted((r.name2, r.keep, r.validation_reason) for r in out.annotated.collect()) == [("b", True, "said"), ("b", True, "said"), ("c", False, "said"), ("c", False, "said")]
    again = J.LLMValidator(_judge("?"), max_retries=1).validate(pairs, entities, decided=out.annotated.where("name2 = 'c'"))
    assert sorted((r.name2, r.keep, r.validation_reason) for r in again.annotated.collect()) == [("b", True, J.KEPT_ON_FAILURE)] * 2 + [("c", False, "said")] * 2
    by_ids = J.LLMValidator(_judge("?"), max_retries=1).validate(pairs, entities, decided=spark.createDataFrame([(1, 2, False, "before")], "id1 long, id2 long, keep boolean, validation_reason string"))
    assert sorted(r.validation_reason for r in by_ids.annotated.collect()) == [J.KEPT_ON_FAILURE, "before", "before", "before"]


def test_python_predicates(spark, df):
    pairs = FuzzyMatcher(threshold=60).find_matches(df).pairs
    rows = pairs.collect()

    def same_start(pair):
        return pair["name1"][:1] == pair["name2"][:1]

    def raises(pair):
        return 1 / 0 if pair["country_1"] is not None else False

    out = RuleBasedValidator(0, custom_rules={"start": same_start, "bad": raises, "column": lambda: F.col("similarity_score") > 0}).validate(pairs, df)
    got = {(r.id1, r.id2): r for r in out.annotated.collect()}
    countries = {r.id: r.country for r in df.collect()}
    for r in rows:
        said = got[r.id1, r.id2]
        start, known = r.name1[:1] == r.name2[:1], countries[r.id1] is not None
        assert said.keep == (start and known)
        assert ("Failed custom rule: start" in said.validation_reason) == (not start) and ("Failed custom rule: bad" in said.validation_reason) == (not known)
    assert out.metadata["rule_errors"].get == {"start": 0, "bad": sum(countries[r.id1] is not None for r in rows)} and rows


def test_facts_of_validation_are_observed_by_the_job_that_writes(spark, df):
    pairs = FuzzyMatcher(threshold=60).find_matches(df).stored().pairs
    out = RuleBasedValidator(90, custom_rules={"fails": lambda pair: 1 / 0}).validate(pairs, df)
    stored = out.stored()
    kept, n = out.validated_pairs.count(), pairs.count()
    want = {"min_score": 90, "metadata_rules_count": 0, "custom_rules_count": 1, "rule_errors": {"fails": n}, "validated_count": kept, "removed_count": n - kept, "validation_rate": kept / n}
    assert stored.metadata == want and 0 < kept < n and stored.removed_pairs.count() == n - kept
    nothing = RuleBasedValidator(90).validate(pairs.limit(0), df).stored()
    assert [nothing.metadata[k] for k in ("validated_count", "removed_count", "validation_rate")] == [0, 0, 0.0] and nothing.annotated.count() == 0


def test_batches_of_the_judge_are_counted(spark, df, tmp_path):
    class Model:
        model, provider = "m", "p"

        def __call__(self):
            return lambda prompt: '{"decisions": [{"pair_index": 0, "is_duplicate": false, "reason": "no"}]}'

    rows = [(i, i + 100, "a", f"b{i}", 90.0) for i in range(7)]
    pairs = spark.createDataFrame(rows, "id1 long, id2 long, name1 string, name2 string, similarity_score double")
    none = spark.createDataFrame([], "id long, name string")
    judge = J.LLMValidator(Model(), batch_size=3, n_workers=1, instructions="x")
    out = judge.validate(pairs, none).stored().metadata
    assert [out[k] for k in ("model", "provider", "batches_processed", "batches_from_checkpoint", "custom_rules_applied")] == ["m", "p", 3, 0, True]
    assert [out[k] for k in ("validated_count", "removed_count")] == [4, 3]
    judge.progress_groups = 1
    folder = str(tmp_path / "progress")
    first = judge.validate(pairs.where("id1 < 3"), none, progress=folder).metadata
    assert (first["batches_processed"], first["batches_from_checkpoint"]) == (1, 0)
    second = judge.validate(pairs, none, progress=folder).stored().metadata
    assert (second["batches_processed"], second["batches_from_checkpoint"], second["validated_count"] + second["removed_count"]) == (3, 1, 7)
    assert J.LLMValidator(_judge("?"), max_retries=1).validate(pairs.limit(0), none).metadata["batches_processed"] == 0


def test_facts_of_inputs(spark):
    raw = spark.createDataFrame([("1", " a ", None), ("2", None, "x"), ("1", "b", "x"), ("4", "y" * 10_001, "x")], "id string, name string, tier string")
    one = I.DeduplicationInput(additional_columns=["tier"]).check(raw)
    assert (one.metadata["original_row_count"], one.metadata["final_row_count"], one.metadata["columns_validated"]) == (4, 2, ["id", "name", "tier"])
    assert any("tier" in w for w in one.warnings)
    two = I.CrossDatasetInput().check(raw, raw.limit(1))
    both = I.cross_input_metadata(*two)
    assert [both[f"df{i}_{k}"] for k in ("original_rows", "final_rows") for i in (1, 2)] == [4, 1, 2, 1]
    assert both["df2_quality_score"] == two[1].metadata["data_quality_score"] and both["validation_warnings"] == two[0].warnings + two[1].warnings
    with pytest.raises(DataValidationError):
        I.DeduplicationInput(additional_columns=["absent"]).check(raw)


def test_a_result_of_many_equal_names_is_saved_as_classes(spark, tmp_path):
    # 40,000 rows of two linked names: 800 million pairs, which are counted and saved without being expanded
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "large ring").otherwise("large rings").alias("name"))
    matcher = FuzzyMatcher(threshold=80)
    classes = matcher.find_matches(rows).classes
    groups = G.cluster_by_name(rows.withColumn("n", matcher.normalised(F.col("name"))), classes.links, "n")
    R.save_dedup(G.DedupResult(groups, None, G.statistics(groups, n_pairs=classes.count()), classes), str(tmp_path / "out"))
    loaded = R.load_dedup(spark, str(tmp_path / "out"))
    assert loaded.statistics.first().duplicate_pairs == 40_000 * 39_999 // 2
    assert [r.entity_id for r in loaded.get_entities_to_keep("last").collect()] == [39_999]
    assert loaded.classes.links.count() == 1 and loaded.classes.rows.count() == 40_000


def test_rules_count_classes_as_they_judge_pairs(spark):
    rows = [(i, ["large ring", "large rings"][i % 2], [None, "x", "y"][i % 3], float(i % 4 * 20 + 40), i % 5) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, name string, brand string, price double, size int")
    rules = {"brand": {"operator": "exact"}, "price": {"operator": "inequality", "max_diff_percent": 40.0}, "name": {"operator": "fuzzy", "threshold": 90.0}}
    found = FuzzyMatcher(threshold=80).find_matches(df)
    for custom, told in ((lambda: F.abs(F.col("size_1") - F.col("size_2")) <= 2, True), (lambda: F.col("size_1") <= F.col("size_2"), False)):
        judge = RuleBasedValidator(90, rules, {"size": custom})
        out, plain = judge.validate(found, df), judge.validate(found.pairs, df)
        assert (out.tally() is not None) == told
        want = plain.annotated.agg(F.count("*"), F.count_if("keep")).first()
        assert out.counts().first()[:2] == want and want[0] == 435
        assert out.flags.where("keep").count() == want[1]


def test_judge_is_asked_once_about_rows_that_it_is_told_the_same_of(spark):
    rows = [(i, ["Large ring", "large rings"][i % 2], [None, "x"][i // 2 % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, name string, country string")
    found = FuzzyMatcher(threshold=80).find_matches(df)
    said = '{"decisions": [{"pair_index": 0, "is_duplicate": false, "reason": "r"}]}'
    out = J.LLMValidator(_judge(said), batch_size=1, metadata_columns=["country"]).validate(found, df)
    assert out.metadata["batches_processed"] <= 16  # of 780 pairs: four kinds of rows in either order
    got = out.annotated.agg(F.count("*"), F.count_if("keep"), F.count_distinct("id1", "id2")).first()
    assert tuple(got) == (780, 0, 780) and out.tally() == (780, 0)
