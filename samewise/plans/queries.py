"""Registered queries of the entity-resolution operators, all over whole tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions import normalize as N
from samewise.operators import consolidate as C
from samewise.operators import groups as G
from samewise.operators import inputs as I
from samewise.operators import pairs as P
from samewise.operators.cap import degree_cap
from samewise.operators.judge import LLMValidator, consolidate_by_judge
from samewise.operators.match import FuzzyMatcher
from samewise.operators.rules import RuleBasedValidator
from samewise.plans import resolve as R
from samewise.plans.resolve import DeduplicationPipeline
from samewise.sources import files
from samewise.sources.shared import materialize, new_path
from samewise.streaming.requests import burst_counts

#: Thresholds by scorer; the oracles use them too.
THRESHOLDS = {"ratio": 60.0, "partial_ratio": 75.0, "token_sort_ratio": 60.0, "token_set_ratio": 60.0, "WRatio": 75.0, "jaro": 0.75, "jaro_winkler": 0.8}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_brand", "p_type", "p_size", "p_retailprice")


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part name: its words in reverse order, and the name's smallest key and brand."""
    per = _parts(spark, sf_dir).groupBy("name").agg(F.min("id").alias("cid"), F.min("p_brand").alias("brand"), F.min("p_type").alias("kind"))
    return per.select("cid", F.array_join(F.reverse(F.split("name", " ")), " ").alias("alt_name"), "brand", "kind")


def _pairs_of(scorer: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = FuzzyMatcher(threshold=THRESHOLDS[scorer], scorer=scorer).find_name_pairs(_parts(spark, sf_dir))
        return found.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), "similarity_score")

    query.__doc__ = f"Pairs of distinct part names by {scorer}."
    return query


def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and customer names, normalised without punctuation, and with sorted tokens."""
    named = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).union(_table(spark, sf_dir, "customer").select("c_custkey", "c_name"))
    plain = N.preprocess(F.col("name"), remove_punctuation=True)
    return named.select("id", "name", plain.alias("normalized"), N.sorted_tokens(plain).alias("sorted_tokens"))


def match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part rows by token_sort_ratio, equal names expanded."""
    return FuzzyMatcher(threshold=85.0).find_matches(_parts(spark, sf_dir)).pairs


def symmetric_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both directions of the catalog's cross match with itself, one row per unordered pair."""
    cat = _catalog(spark, sf_dir).select(F.col("cid").alias("id"), F.col("alt_name").alias("name"))
    found = FuzzyMatcher(threshold=60.0, scorer="ratio").find_cross_matches(cat, cat).pairs
    return P.remove_symmetric(found.select("id1", "id2", "name1", "name2", "similarity_score")).select(F.least("id1", "id2").alias("id_a"), F.greatest("id1", "id2").alias("id_b"), "similarity_score")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DeduplicationPipeline(FuzzyMatcher(threshold=80.0)).run_by_name(_parts(spark, sf_dir))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part rows in groups of names that are linked by token_sort_ratio."""
    return _groups(spark, sf_dir)


def dedup_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.statistics(_groups(spark, sf_dir))


def group_size_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.analyze(_groups(spark, sf_dir))


def _survivors(strategy: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = _parts(spark, sf_dir)
        return G.remove_duplicates(parts, _groups(spark, sf_dir), strategy=strategy).select("id", "name", "p_brand")

    query.__doc__ = f"Part rows that survive with strategy {strategy}."
    return query


def survivors_highest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows that survive: of each group the one with the highest mean score."""
    cat = _catalog(spark, sf_dir).select(F.col("cid").alias("id"), F.col("alt_name").alias("name"))
    result = DeduplicationPipeline(FuzzyMatcher(threshold=70.0, scorer="ratio")).run(cat)
    return result.remove_duplicates(cat, strategy="highest_score")


def removal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = materialize(_groups(spark, sf_dir), "groups")
    return G.removal_summary(groups, G.remove_duplicates(_parts(spark, sf_dir), groups))


def _validator() -> RuleBasedValidator:
    rules = {"p_brand": {"operator": "exact"}, "p_type": {"operator": "fuzzy", "threshold": 40.0}, "p_retailprice": {"operator": "inequality", "max_diff_percent": 30.0}}
    return RuleBasedValidator(90.0, rules, {"size": lambda: F.abs(F.col("p_size_1") - F.col("p_size_2")) <= 25})


def rule_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts under score, exact, fuzzy, inequality and custom rules, with the number of reasons."""
    parts = _parts(spark, sf_dir)
    found = FuzzyMatcher(threshold=85.0).find_matches(parts)
    return _validator().validate(found, parts).flags.select("id1", "id2", "keep", "reasons")


def _cross(spark: SparkSession, sf_dir: str, multi: bool = False) -> DataFrame:
    left, right = (["name", "p_type"], ["alt_name", "kind"]) if multi else ("name", "alt_name")
    matcher = FuzzyMatcher(threshold=75.0)
    return matcher.find_cross_matches(_parts(spark, sf_dir), _catalog(spark, sf_dir), "id", "cid", left, right).pairs


def cross_match_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against the catalog by name."""
    return _cross(spark, sf_dir).select("id1", "id2", "name1", "name2", "similarity_score")


def cross_match_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts against the catalog by name or type, the best score of each pair."""
    return _cross(spark, sf_dir, True).select("id1", "id2", "similarity_score", "matched_column1", "matched_column2")


def cross_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cross_statistics(P.cross_matches(_cross(spark, sf_dir)), _parts(spark, sf_dir), _catalog(spark, sf_dir), "id", "cid")


def merge_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and catalog joined through their matches."""
    merged = P.merge_datasets(P.cross_matches(_cross(spark, sf_dir)), _parts(spark, sf_dir), _catalog(spark, sf_dir), "id", "cid")
    return merged.select("df1_id", "df2_id", "similarity_score", "name", "p_brand", "alt_name", "brand")


def _consolidated(mode: str | None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        order = [f"Brand#{i}" for i in range(1, 26)]
        config = C.ConsolidationConfig(enabled=True, priority_column="brand" if mode else None, priority_order=order if mode else [], priority_mode=mode or "strict", priority_threshold=15.0)
        out = C.consolidate(P.cross_matches(_cross(spark, sf_dir)), _parts(spark, sf_dir), _catalog(spark, sf_dir), "id", "cid", config)
        return out.select("id", "main_cid", "main_similarity_score", "other_candidates", "total_matches", "all_match_ids")

    query.__doc__ = f"The main catalog match of every part, {mode or 'by best score'}."
    return query


def degree_capped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name pairs by ratio, at most two for each name, the best first."""
    pairs = _pairs_of("ratio")(spark, sf_dir)
    return degree_cap(pairs, 2, ["name_a"], ["name_b"], F.struct(-F.col("similarity_score"), "name_a", "name_b"))


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.quality_score(_table(spark, sf_dir, "customer"), "c_custkey", "c_name")


def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: how many rows are valid, and why others are not."""
    reason = I.reject_reason(F.col("doc_id"), F.col("text"))
    return _table(spark, sf_dir, "documents").groupBy(F.coalesce(reason, F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


def sanitized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts without control characters and script fragments, white space collapsed."""
    return _table(spark, sf_dir, "documents").select("doc_id", N.sanitize_text(F.col("text"), max_length=2**31 - 1).alias("text"))


def excel_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.clean_for_excel(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets found in documents."""
    found = N.find_secrets(_table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.select("doc_id", "type", "value", "nth", "position")


def burst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and minute."""
    return burst_counts(_table(spark, sf_dir, "events"), 60)


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as CSV and read back."""
    table, path = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), new_path(spark, "suppliers") + ".csv"
    files.save_data(table, path)
    return files.load_data(spark, path, table.schema)


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back."""
    table, path = _table(spark, sf_dir, "documents").select("doc_id", "text", "source"), new_path(spark, "documents") + ".json"
    files.save_data(table, path)
    return files.load_data(spark, path, table.schema)


def _saved(spark: SparkSession, sf_dir: str) -> G.DedupResult:
    """The groups of parts and the classes of equal names whose pairs make them as a result, saved and loaded."""
    parts = _parts(spark, sf_dir)
    matcher = FuzzyMatcher(threshold=80.0)
    classes = matcher.find_matches(parts).classes
    named = parts.withColumn("_norm", matcher.normalised(F.col("name")))
    groups = materialize(G.cluster_by_name(named, classes.links, "_norm"), "groups")
    path = new_path(spark, "result")
    R.save_dedup(G.DedupResult(groups, None, G.statistics(groups, n_pairs=classes.count()), classes), path)
    return R.load_dedup(spark, path)


def saved_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity groups of a result that was saved and loaded."""
    return _saved(spark, sf_dir).entity_groups


def saved_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a result that was saved and loaded, and how many its statistics speak of."""
    result = _saved(spark, sf_dir)
    return result.pairs().select("id1", "id2", "name1", "name2", "similarity_score", F.lit(result.statistics.first().duplicate_pairs).cast("long").alias("duplicate_pairs"))


def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of part 1."""
    return _saved(spark, sf_dir).get_group(1).select("entity_id", "entity_name")


def entities_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that survive with strategy last."""
    return _saved(spark, sf_dir).get_entities_to_keep("last")


def _cross_result(spark: SparkSession, sf_dir: str) -> P.CrossResult:
    """The cross match of parts and catalog, saved and loaded."""
    path = new_path(spark, "cross")
    R.save_cross(P.CrossResult(P.cross_matches(_cross(spark, sf_dir)), {"id_col": "id", "name_col": "name"}, {"id_col": "cid", "name_col": "alt_name"}), path)
    return R.load_cross(spark, path)


def saved_cross_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a cross result that was saved and loaded."""
    return _cross_result(spark, sf_dir).cross_matches.select("df1_id", "df2_id", "df1_name", "df2_name", "similarity_score", "validation_reason")


def matches_of_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What part 1 matches in the catalog."""
    return _cross_result(spark, sf_dir).get_df1_matches(1).select("df2_id", "df2_name", "similarity_score")


def matches_of_catalog_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts match the catalog's entry 1."""
    return _cross_result(spark, sf_dir).get_df2_matches(1).select("df1_id", "df1_name", "similarity_score")


def merge_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and catalog joined through near equal names, unmatched rows of both kept."""
    result = _cross_result(spark, sf_dir)
    strong = P.CrossResult(result.cross_matches.where("similarity_score >= 95"), result.df1_metadata, result.df2_metadata)
    return strong.merge_datasets(_parts(spark, sf_dir).select("id", "name"), _catalog(spark, sf_dir).select("cid", "alt_name"), "outer").select("df1_id", "df2_id", "similarity_score", "id", "cid", "alt_name")


def enriched_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross matches with metadata of both sides and the priority column."""
    config = C.ConsolidationConfig(enabled=True, priority_column="kind", df1_metadata_columns=["p_brand", "p_size"], df2_metadata_columns=["brand", "absent"])
    rich = C.enrich(P.cross_matches(_cross(spark, sf_dir)), _parts(spark, sf_dir), _catalog(spark, sf_dir), "id", "cid", config)
    return rich.select("df1_id", "df2_id", "similarity_score", "p_brand", "p_size", "brand", F.col("_priority").alias("priority"))


def _consolidated_with(**how) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = C.consolidate(P.cross_matches(_cross(spark, sf_dir)), _parts(spark, sf_dir), _catalog(spark, sf_dir), "id", "cid", C.ConsolidationConfig(enabled=True, **how))
        return out.select("id", "main_cid", "main_similarity_score", "other_candidates", "total_matches", "all_match_ids")

    query.__doc__ = f"The main catalog match of every part, with {' and '.join(how)}."
    return query


def scaled_jaro_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of distinct part names by jaro on a scale of 100."""
    found = FuzzyMatcher(threshold=75.0, scorer="jaro", score_multiplier=100.0, scale_cutoff=True).find_name_pairs(_parts(spark, sf_dir))
    return found.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), "similarity_score")


def match_pairs_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part rows under an id that repeats (the size) and an order with ties (the brand)."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("id"), F.col("p_name").alias("name"), "p_brand")
    return FuzzyMatcher(threshold=85.0).find_matches(rows, order_by="p_brand").pairs


def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows were matched, and how many pairs found."""
    return FuzzyMatcher(threshold=85.0).find_matches(_parts(spark, sf_dir)).counts()


def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of parts the rules keep."""
    parts = _parts(spark, sf_dir)
    return _validator().validate(FuzzyMatcher(threshold=85.0).find_matches(parts), parts).counts()


def structure_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and nulls of the columns that documents need."""
    return I.structure_counts(_table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"])


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"))


def checked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: the rows that pass all checks, sanitised."""
    return I.DeduplicationInput().check(_entities(spark, sf_dir)).valid.select("id", "name")


def rejected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entities: the rows that do not pass, and why."""
    return I.DeduplicationInput().check(_entities(spark, sf_dir)).rejected.select("id", "reject_reason")


def checked_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and suppliers as two tables of entities: how many rows of each pass."""
    right = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"))
    sides = I.CrossDatasetInput(("id", "key"), ["name"], ["title"]).check(_entities(spark, sf_dir), right)
    one = lambda n: sides[n].valid.agg(F.lit(f"df{n + 1}").alias("side"), F.count("*").alias("n"))
    return one(0).union(one(1))


def sanitized_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and properties of events without control characters and script fragments; nulls stay."""
    return N.sanitize_columns(_table(spark, sf_dir, "events").select("event_id", "event_type", "props"), ["event_type", "props", "absent"])


def reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON in texts around it: fenced for even events, bare for others."""
    around = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("so: ```json\n"), "props", F.lit("\n``` ok }"))).otherwise(F.concat(F.lit("it is "), "props", F.lit(" I think")))
    return _table(spark, sf_dir, "events").select("event_id", N.extract_json(around).alias("json"))


def match_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of three matches, as the jobs that wrote their tables observed them, pairs counted by classes of equal names: parts
    with parts, parts with the catalog by name, and by two columns each, one of the catalog's and one that no table has."""
    parts, catalog = _parts(spark, sf_dir), _catalog(spark, sf_dir)
    named = parts.withColumn("name", F.when(F.col("id") % 10 != 0, F.col("name")))
    matcher = FuzzyMatcher(threshold=85.0, batch_size=64)
    runs = (
        matcher.find_matches(named),
        matcher.find_cross_matches(named, catalog, "id", "cid", "name", "alt_name"),
        matcher.find_cross_matches(named, catalog, "id", "cid", ["name", "p_type"], ["alt_name", "absent"]),
    )
    rows = []
    for m in (r.counted().metadata for r in runs):
        found = m["matches_found"] if "total_entities" in m else m["cross_matches_found"]
        rows.append((m.get("matching_type", "self"), m["threshold"], m["scorer"], m.get("total_entities", m.get("df1_entities")), m.get("df2_entities"), found, m.get("batches_processed"), m.get("total_combinations_tried"), m["preprocessing"]["lowercase"]))
    return spark.createDataFrame(rows, "matching_type string, threshold double, scorer string, entities long, entities2 long, found long, batches long, combinations long, lowercase boolean")


class _ByScore:
    """A stand-in for a model in the judge's queries. It reads the prompt and answers by the scores in it, in a fenced block
    with talk around it: a pair is a duplicate from 90 on; of an entity's candidates it takes the one of least id."""

    model, provider = "by-score", "none"

    def __call__(self):
        return self.reply

    @staticmethod
    def reply(prompt: str) -> str:
        pairs = [(int(i), float(s)) for i, s in re.findall(r"^(\d+)\. .*, score (\d+\.\d)", prompt, re.M)]
        said: dict = {"decisions": [{"pair_index": i, "is_duplicate": "yes" if s >= 90 else "no", "reason": f"at {s}"} for i, s in pairs]}
        if not pairs:
            parts = re.split(r"^Entity (\S+) \(", prompt, flags=re.M)[1:]
            ids = [(e, re.findall(r"^  \d+\. id (\d+):", t, re.M)) for e, t in zip(parts[::2], parts[1::2], strict=True)]
            said = {"selections": [{"entity_id": e, "selected_candidate_id": min(c, key=int), "reasoning": f"of {len(c)}"} for e, c in ids]}
        return f"I {{looked}} at them.\n```json\n{json.dumps(said)}\n```\nThat is all."


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of parts as a judge decides them that goes by the score it is told."""
    parts = _parts(spark, sf_dir)
    found = FuzzyMatcher(threshold=85.0).find_matches(parts)
    return LLMValidator(_ByScore(), metadata_columns=["p_brand"]).validate(found, parts).annotated.select("id1", "id2", "keep", "validation_reason")


def judged_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog entry of every part that a judge chooses which takes the candidate of least id."""
    matches = P.cross_matches(_cross(spark, sf_dir))
    out = consolidate_by_judge(matches, _parts(spark, sf_dir), "id", _ByScore(), "cid", df2=_catalog(spark, sf_dir), df2_key="cid", metadata_columns=("brand",))
    return out.select("id", "main_cid", "main_similarity_score", "total_matches", "llm_reasoning", "other_candidates")


def validation_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules and the judge tell of their pairs, counted by classes of rows that are alike to them."""
    parts = _parts(spark, sf_dir)
    found = FuzzyMatcher(threshold=85.0).find_matches(parts)
    ruled = _validator().validate(found, parts).counted().metadata
    judged = LLMValidator(_ByScore(), instructions="Mind the brand.", metadata_columns=["p_brand"]).validate(found, parts).counted().metadata
    rows = [("rules", ruled["validated_count"], ruled["removed_count"], ruled["validation_rate"], ruled["min_score"], ruled["metadata_rules_count"], ruled["custom_rules_count"], None, None, None)]
    rows.append(("judge", judged["validated_count"], judged["removed_count"], judged["validation_rate"], None, None, None, judged["model"], judged["custom_rules_applied"], judged["batches_from_checkpoint"]))
    return spark.createDataFrame(rows, "kind string, validated_count long, removed_count long, validation_rate double, min_score double, metadata_rules_count long, custom_rules_count long, model string, custom_rules_applied boolean, batches_from_checkpoint long")


def input_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the checks of documents, and of documents and suppliers as two tables, tell of their rows."""
    one = I.DeduplicationInput(additional_columns=["lang"]).check(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("name"), "lang")).metadata
    right = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"))
    two = I.cross_input_metadata(*I.CrossDatasetInput(("id", "key"), ["name"], ["title"]).check(_entities(spark, sf_dir), right))
    rows = [("self", one["original_row_count"], one["final_row_count"], None, None, ", ".join(one["columns_validated"]))]
    rows.append(("cross", two["df1_original_rows"], two["df1_final_rows"], two["df2_original_rows"], two["df2_final_rows"], None))
    return spark.createDataFrame(rows, "kind string, original_rows long, final_rows long, original_rows2 long, final_rows2 long, columns_validated string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "normalize_names": normalize_names,
    **{f"{k.lower()}_pairs": _pairs_of(k) for k in THRESHOLDS},
    "match_pairs": match_pairs,
    "symmetric_pairs": symmetric_pairs,
    "duplicate_groups": duplicate_groups,
    "dedup_statistics": dedup_statistics,
    "group_size_analysis": group_size_analysis,
    "survivors_first": _survivors("first"),
    "survivors_last": _survivors("last"),
    "survivors_highest_score": survivors_highest_score,
    "removal_summary": removal_summary,
    "rule_validation": rule_validation,
    "cross_match_single": cross_match_single,
    "cross_match_multi": cross_match_multi,
    "cross_statistics": cross_statistics,
    "merge_datasets": merge_datasets,
    "consolidate_strict": _consolidated("strict"),
    "consolidate_threshold": _consolidated("threshold"),
    "consolidate_best": _consolidated(None),
    "degree_capped_pairs": degree_capped_pairs,
    "quality_score": quality_score,
    "input_validation": input_validation,
    "sanitized_documents": sanitized_documents,
    "excel_clean": excel_clean,
    "secret_scan": secret_scan,
    "burst_windows": burst_windows,
    "csv_round_trip": csv_round_trip,
    "json_round_trip": json_round_trip,
    "saved_groups": saved_groups,
    "saved_pairs": saved_pairs,
    "group_members": group_members,
    "entities_kept": entities_kept,
    "saved_cross_matches": saved_cross_matches,
    "matches_of_part": matches_of_part,
    "matches_of_catalog_entry": matches_of_catalog_entry,
    "merge_outer": merge_outer,
    "enriched_matches": enriched_matches,
    "consolidate_filtered": _consolidated_with(filter_function=lambda: F.col("similarity_score") >= 90),
    "consolidate_selected": _consolidated_with(selection_function=lambda g: g.sort_values("df2_id").iloc[0]),
    "scaled_jaro_pairs": scaled_jaro_pairs,
    "match_pairs_tied": match_pairs_tied,
    "match_counts": match_counts,
    "validation_counts": validation_counts,
    "structure_report": structure_report,
    "checked_entities": checked_entities,
    "rejected_entities": rejected_entities,
    "checked_sides": checked_sides,
    "sanitized_columns": sanitized_columns,
    "reply_json": reply_json,
    "match_metadata": match_metadata,
    "judged_pairs": judged_pairs,
    "judged_consolidation": judged_consolidation,
    "validation_metadata": validation_metadata,
    "input_metadata": input_metadata,
}
