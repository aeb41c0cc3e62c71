"""The two pipelines: duplicates within a table, and matches between two tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, is_dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.errors import DataValidationError
from samewise.operators import groups as G
from samewise.operators import pairs as P
from samewise.operators.judge import LLMValidator
from samewise.operators.match import FuzzyMatcher, NameClasses
from samewise.operators.rules import RuleBasedValidator
from samewise.sources.checkpoint import checkpointer, fingerprint, resume_or_save

GROUPS = "entity_id string, entity_name string, group_id long"


def _settings(x) -> object:
    """What a checkpoint key holds of a matcher, validator or setting: all plain fields. A function stands for its
    `version` if it has one, else for its name and code."""
    if is_dataclass(x) and not isinstance(x, type):
        return {"type": type(x).__name__, **{f.name: _settings(getattr(x, f.name)) for f in fields(x) if f.name not in ("progress", "progress_groups")}}
    if isinstance(x, dict):
        return {str(k): _settings(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_settings(v) for v in x]
    if isinstance(x, Column):
        return str(x)
    if hasattr(x, "version"):
        return {"version": str(x.version)}
    if code := getattr(x, "__code__", None):
        held = [_settings(c.cell_contents) for c in x.__closure__ or ()]
        return {"function": x.__qualname__, "code": md5(code.co_code + repr([c for c in code.co_consts if not hasattr(c, "co_code")]).encode() + repr(code.co_names).encode()).hexdigest(), "held": held}
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    return {"type": type(x).__name__, **({k: _settings(v) for k, v in vars(x).items()} if hasattr(x, "__dict__") and not callable(x) else {})}


@dataclass
class DeduplicationPipeline:
    """match -> remove symmetric pairs -> validate -> cluster, with checkpoints after matching and validation.

    Any matcher with find_matches and any validator with validate fits.
    """

    matcher: FuzzyMatcher
    validator: RuleBasedValidator | None = None
    checkpoint: bool = False
    checkpoint_dir: str = ".samewise_checkpoints"
    checkpoint_type: str = "file"
    checkpoint_compress: bool = True

    def _store(self, spark: SparkSession):
        return checkpointer(spark, self.checkpoint_type, self.checkpoint_dir, compress=self.checkpoint_compress) if self.checkpoint else None

    def run(self, df: DataFrame, id_column: str = "id", name_column: str = "name", validate: bool = True, resume: bool = True) -> G.DedupResult:
        for c in (id_column, name_column):
            if c not in df.columns:
                raise DataValidationError(f"column {c} is missing", columns=df.columns)
        for old, new in ((id_column, "id"), (name_column, "name")):
            if old != new and new in df.columns and new not in (id_column, name_column):
                raise DataValidationError(f"column {old} would take the name of column {new}", columns=df.columns)
        names = {id_column: "id", name_column: "name"}
        own = df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
        store = self._store(df.sparkSession)
        key = fingerprint(own, ["id", "name"], {"matcher": _settings(self.matcher)}) if store else ""
        found = resume_or_save(store, "matching", key, resume, lambda: self.matcher.find_matches(own).pairs)
        pairs = P.remove_symmetric(found)
        if validate and self.validator is not None:
            columns = self._read(own, ["id", "name"])
            vkey = fingerprint(own, columns, {"matcher": _settings(self.matcher), "validator": _settings(self.validator)}) if store else ""
            annotated = resume_or_save(store, "validation", vkey, resume, lambda: self.validator.validate(pairs, own, **self._progress(store, vkey)).annotated)
            pairs = annotated.where("keep").drop("keep")
        groups = G.cluster(own, pairs)
        return G.DedupResult(groups, pairs, G.statistics(groups, pairs=pairs))

    def _read(self, df: DataFrame, columns: list[str]) -> list[str]:
        """The columns of df that decisions depend on: those given and the validator's; all of them with custom rules."""
        if getattr(self.validator, "custom_rules", None):
            return sorted(df.columns)
        return sorted({*columns, *getattr(self.validator, "metadata_rules", {}), *getattr(self.validator, "metadata_columns", [])} & {*df.columns})

    def _progress(self, store, key: str) -> dict:
        """A judge keeps its decisions beside the checkpoints as it makes them."""
        return {"progress": store.store.path(f"progress_{key}.parquet")} if store and isinstance(self.validator, LLMValidator) else {}

    def run_by_name(self, df: DataFrame, id_column: str = "id", name_column: str = "name") -> DataFrame:
        """Entity groups without expanding equal names into pairs of rows; for tables with large groups of equal names."""
        edges = self.matcher.find_name_pairs(df, name_column)
        named = df.withColumn("_norm", self.matcher.normalised(F.col(name_column)))
        return G.cluster_by_name(named, edges, "_norm", id_column, name_column)

    def run_cross_dataset(self, df1: DataFrame, df2: DataFrame, id_column1: str = "id", id_column2: str = "id", name_columns1: str | list[str] = "name", name_columns2: str | list[str] = "name", validate: bool = True, resume: bool = True) -> P.CrossResult:
        if not hasattr(self.matcher, "find_cross_matches"):
            raise DataValidationError("the matcher has no find_cross_matches")
        store = self._store(df1.sparkSession)
        first = lambda c: c if isinstance(c, str) else c[0]
        key = "_".join(fingerprint(d, [i, *([n] if isinstance(n, str) else n)], {"matcher": _settings(self.matcher)})[:16] for d, i, n in ((df1, id_column1, name_columns1), (df2, id_column2, name_columns2))) if store else ""
        pairs = resume_or_save(store, "cross_matching", key, resume, lambda: self.matcher.find_cross_matches(df1, df2, id_column1, id_column2, name_columns1, name_columns2).pairs)
        if validate and self.validator is not None:
            sides = ((df1, id_column1, name_columns1), (df2, id_column2, name_columns2))
            settings = {"matcher": _settings(self.matcher), "validator": _settings(self.validator)}
            vkey = "_".join(fingerprint(d, self._read(d, [i, *([n] if isinstance(n, str) else n)]), settings)[:16] for d, i, n in sides) if store else ""
            annotated = resume_or_save(store, "cross_validation", vkey, resume, lambda: self.validator.validate(pairs, df1, id_column1, entities2=df2, id_column2=id_column2, **self._progress(store, vkey)).annotated)
            pairs = annotated.where("keep").drop("keep")
        matches = P.cross_matches(pairs)
        side = lambda i, n: {"id_col": i, "name_col": first(n)}
        return P.CrossResult(matches, side(id_column1, name_columns1), side(id_column2, name_columns2), P.cross_statistics(matches, df1, df2, id_column1, id_column2))


def _write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One line of JSON, through Spark, so that any store it knows takes it."""
    spark.createDataFrame([(json.dumps(value, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save_dedup(result: G.DedupResult, folder: str) -> None:
    """entity_groups and duplicate_pairs as Parquet, statistics as JSON, in a folder of any store that Spark knows. Pairs given
    as classes are saved as such: rows with a name and links of names, of which pairs() expands the pairs again."""
    spark, classes = result.entity_groups.sparkSession, result.classes
    result.entity_groups.write.mode("overwrite").parquet(f"{folder}/entity_groups.parquet")
    if classes is None:
        result.duplicate_pairs.write.mode("overwrite").parquet(f"{folder}/duplicate_pairs.parquet")
    else:
        classes.rows.write.mode("overwrite").parquet(f"{folder}/named_rows.parquet")
        classes.links.write.mode("overwrite").parquet(f"{folder}/name_links.parquet")
    stats = result.statistics.first().asDict()
    _write_json(spark, stats if classes is None else {**stats, "_classes": {"same": classes.same}}, f"{folder}/statistics.json")


def load_dedup(spark: SparkSession, folder: str) -> G.DedupResult:
    stats = _read_json(spark, f"{folder}/statistics.json")
    how = stats.pop("_classes", None)
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    pairs = read("duplicate_pairs") if how is None else None
    classes = NameClasses(read("named_rows"), read("name_links"), how["same"]) if how else None
    return G.DedupResult(read("entity_groups"), pairs, spark.createDataFrame([stats]), classes)


def save_cross(result: P.CrossResult, folder: str) -> None:
    result.cross_matches.write.mode("overwrite").parquet(f"{folder}/cross_matches.parquet")
    stats = result.statistics.first().asDict() if result.statistics is not None else {}
    _write_json(result.cross_matches.sparkSession, {"df1": result.df1_metadata, "df2": result.df2_metadata, "statistics": stats}, f"{folder}/metadata.json")


def load_cross(spark: SparkSession, folder: str) -> P.CrossResult:
    meta = _read_json(spark, f"{folder}/metadata.json")
    stats = spark.createDataFrame([meta["statistics"]]) if meta["statistics"] else None
    return P.CrossResult(spark.read.parquet(f"{folder}/cross_matches.parquet"), meta["df1"], meta["df2"], stats)
