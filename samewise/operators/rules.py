"""Rule-based validation of pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from inspect import signature

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from samewise.functions.scorers import score
from samewise.operators.match import MatchResult, NameClasses
from samewise.operators.order import spread
from samewise.operators.pairs import first_rows
from samewise.sources.shared import materialize, materialize_counted

PASSED = "Passed all rules"
#: Most values of a column that a fuzzy rule compares two by two before it looks at pairs.
_FEW = 256


@dataclass
class ValidationResult:
    """All pairs with `keep` and `validation_reason`, and the two views of them."""

    annotated: DataFrame
    metadata: dict = field(default_factory=dict)
    #: The pairs with `keep` and the number of `reasons` against them, without their texts; of rules only.
    flags: DataFrame | None = None
    #: Of a match by classes: how many pairs there are and are kept, counted by classes; None if these cannot tell.
    tally: Callable[[], tuple[int, int] | None] | None = None

    @property
    def validated_pairs(self) -> DataFrame:
        return self.annotated.where("keep").drop("keep")

    @property
    def removed_pairs(self) -> DataFrame:
        return self.annotated.where("not keep").drop("keep")

    def stored(self, path: str | None = None) -> ValidationResult:
        """The same result with its annotated pairs written (to path, else to the shared folder). The job that writes them
        counts validated_count, removed_count and validation_rate (0 without pairs) into metadata."""
        facts = {"validated_count": F.count_if("keep"), "removed_count": F.count_if(~F.col("keep"))}
        annotated, seen = materialize_counted(self.annotated, "validated", facts, path)
        n = sum(seen.values())
        told = {k: dict(v.get) if isinstance(v, Observation) else v for k, v in self.metadata.items()}
        return ValidationResult(annotated, {**told, **seen, "validation_rate": seen["validated_count"] / n if n else 0.0})

    def counted(self) -> ValidationResult:
        """The same result with the counts of stored() in its metadata; pairs of classes are counted by class, not written."""
        told = self.tally() if self.tally else None
        if told is None:
            return self.stored()
        n, kept = told
        return ValidationResult(self.annotated, {**self.metadata, "validated_count": kept, "removed_count": n - kept, "validation_rate": kept / n if n else 0.0}, self.flags, self.tally)

    def counts(self) -> DataFrame:
        """One row: pairs kept and removed, and the share kept (0 without pairs)."""
        if self.tally and (told := self.tally()) is not None:
            n, yes = told
            return self.annotated.sparkSession.createDataFrame([(n, yes, n - yes, yes / n if n else 0.0)], "pairs_count long, validated_count long, removed_count long, validation_rate double")
        kept, n = F.count_if("keep"), F.count("*")
        return self.annotated.agg(n.alias("pairs_count"), kept.alias("validated_count"), (n - kept).alias("removed_count"), F.coalesce(F.try_divide(kept, n), F.lit(0.0)).alias("validation_rate"))


def score_rule(minimum: float) -> Column:
    """Reason if the score is below the minimum, else null."""
    s = F.col("similarity_score")
    return F.when(s < minimum, F.format_string(f"Score %.1f < threshold {minimum}", s))


def exact_rule(column: str, a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull() & (a != b), F.concat_ws("", F.lit(f"{column} differs: "), a.cast("string"), F.lit(" vs "), b.cast("string")))


def fuzzy_rule(column: str, s: Column, threshold: float = 80.0) -> Column:
    """Reason if the score s of both values is below the threshold. s should be a column of its own, for it is read twice."""
    return F.when(s < threshold, F.format_string(f"{column} similarity %.1f < {threshold}", s))


def inequality_rule(column: str, a: Column, b: Column, max_diff_percent: float) -> Column:
    """Reason if both are numbers, the larger is above 0, and they differ by more than the percentage of it."""
    x, y = a.try_cast("double"), b.try_cast("double")
    top = F.greatest(x, y)
    diff = F.abs(x - y) / top * 100
    return F.when((top > 0) & x.isNotNull() & y.isNotNull() & (F.when(top > 0, diff) > max_diff_percent), F.format_string(f"{column} difference %.1f%% > {max_diff_percent}%%", F.when(top > 0, diff)))


def _ratios(pairs: DataFrame, column: str, tables: list[DataFrame]) -> DataFrame:
    """pairs with _ratio_<column>, the ratio of <column>_1 and <column>_2. Few values are compared once, two by two."""
    a, b = F.col(f"{column}_1").cast("string"), F.col(f"{column}_2").cast("string")
    values = reduce(DataFrame.union, [t.select(F.col(column).cast("string").alias("v")) for t in tables]).where("v is not null").distinct()
    if values.limit(_FEW + 1).count() > _FEW:
        return pairs.withColumn(f"_ratio_{column}", score("ratio", a, b))
    both = values.select(F.col("v").alias("_va")).crossJoin(values.select(F.col("v").alias("_vb")))
    known = materialize(both.withColumn(f"_ratio_{column}", score("ratio", F.col("_va"), F.col("_vb"))), "ratios")
    return pairs.join(F.broadcast(known), (a == F.col("_va")) & (b == F.col("_vb")), "left").drop("_va", "_vb")


def _needs(rule: Column, pairs: DataFrame, *columns: str) -> bool:
    """Whether the rule cannot be told of pairs without these columns."""
    try:
        return pairs.drop(*columns).select(rule).schema is None
    except AnalysisException:
        return True


def _ask(predicates: dict[str, Callable[[dict], bool]]):
    """A function of pairs (structs): by predicate whether it holds, true if it raised, and whether it did."""

    @F.pandas_udf(", ".join(f"`{n}` struct<holds: boolean, failed: boolean>" for n in predicates))
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        rows = pairs.astype(object).where(pairs.notna(), None).to_dict("records")

        def one(rule: Callable[[dict], bool], row: dict) -> dict:
            try:
                return {"holds": bool(rule(row)), "failed": False}
            except Exception:  # whatever a rule raises keeps the pair
                return {"holds": True, "failed": True}

        return pd.DataFrame({n: [one(rule, row) for row in rows] for n, rule in predicates.items()})

    return run


@dataclass
class RuleBasedValidator:
    """Keeps pairs that pass the score rule, every metadata rule and every custom rule; all rules are evaluated.

    metadata_rules: column -> {'operator': exact | fuzzy | inequality, 'threshold', 'max_diff_percent'}; unknown
    operators and missing columns pass. custom_rules: name -> Column over the pair columns and the metadata
    columns as <column>_1 and <column>_2, true for pairs to keep (null keeps); a function without parameters that returns
    such a Column; or a Python predicate of a pair, a dict of these columns. Predicates run in Arrow batches; one
    that raises keeps the pair, and metadata['rule_errors'] counts these by rule once the result has been read.
    """

    min_score: float = 90.0
    metadata_rules: dict[str, dict] = field(default_factory=dict)
    custom_rules: dict[str, Column | Callable[[], Column] | Callable[[dict], bool]] = field(default_factory=dict)

    def validate(self, pairs: DataFrame | MatchResult, entities: DataFrame, id_column: str = "id", order_by: str | None = None, entities2: DataFrame | None = None, id_column2: str | None = None) -> ValidationResult:
        """Annotate pairs with rows of entities, by id (the first row of an id). A second table serves id2. The match itself
        instead of its pairs joins entities to rows before they pair, and counts by classes of equal rows."""
        found = pairs if isinstance(pairs, MatchResult) else None
        classes = found.classes if found is not None and found.classes is not None and found.classes.others is None and entities2 is None else None
        pairs = pairs if found is None else found.pairs if classes is None else None
        columns = [c for c in self.metadata_rules if c in entities.columns]
        wanted = [c for c in entities.columns if c != id_column] if self.custom_rules else columns
        if classes is not None:
            have = [c for c in wanted if c in entities.columns]
            facts = first_rows(entities.select(id_column, *have, *([order_by] if order_by and order_by not in (id_column, *have) else [])), id_column, order_by).select(F.col(id_column).alias("_id"), *have)
            joined = classes.expand(facts).drop("at1", "at2")
            pairs = joined.select("id1", "id2", "name1", "name2", "similarity_score")
        else:
            joined = self._joined(pairs, entities, wanted, id_column, order_by, entities2, id_column2)
        reasons, scores = [score_rule(self.min_score)], []
        for c in columns:
            if f"{c}_1" not in joined.columns or f"{c}_2" not in joined.columns:
                continue
            rule, a, b = self.metadata_rules[c], F.col(f"{c}_1"), F.col(f"{c}_2")
            kind = rule.get("operator", "exact")
            if kind == "exact":
                reasons.append(exact_rule(c, a, b))
            elif kind == "fuzzy":
                scores.append(c)
                reasons.append(fuzzy_rule(c, F.col(f"_ratio_{c}"), rule.get("threshold", 80.0)))
            elif kind == "inequality" and rule.get("max_diff_percent") is not None:
                reasons.append(inequality_rule(c, a, b, rule["max_diff_percent"]))
        predicates = {n: r for n, r in self.custom_rules.items() if not isinstance(r, Column) and len(signature(r).parameters)}
        for name, rule in self.custom_rules.items():
            holds = F.col("_said")[name]["holds"] if name in predicates else rule if isinstance(rule, Column) else rule()
            reasons.append(F.when(~holds, F.lit(f"Failed custom rule: {name}")))
        tables = [entities] if entities2 is None else [entities, entities2]
        told = reduce(lambda df, c: _ratios(df, c, tables), scores, joined)
        metadata = {"min_score": self.min_score, "metadata_rules_count": len(self.metadata_rules), "custom_rules_count": len(self.custom_rules)}
        if predicates:
            told = told.withColumn("_said", _ask(predicates)(F.struct(*[F.col(f"`{c}`") for c in joined.columns])))
            metadata["rule_errors"] = errors = Observation()
            told = told.observe(errors, *[F.count_if(F.col("_said")[n]["failed"]).alias(n) for n in predicates])
        failed = [r.isNotNull() for r in reasons]
        why = told.withColumn("_why", F.array_compact(F.array(*reasons)))
        out = why.select(*pairs.columns, (F.size("_why") == 0).alias("keep"), F.when(F.size("_why") == 0, PASSED).otherwise(F.array_join("_why", "; ")).alias("validation_reason"))
        flags = told.withColumn("reasons", sum((f.cast("int") for f in failed), F.lit(0))).select(*pairs.columns, (F.col("reasons") == 0).alias("keep"), "reasons")
        tally = None
        if classes is not None and not predicates:
            tally = lambda: self._tally(found, classes, facts, columns, joined, reasons, scores)
        return ValidationResult(out, metadata, flags, tally)

    def _joined(self, pairs: DataFrame, entities: DataFrame, wanted: list[str], id_column: str, order_by: str | None, entities2: DataFrame | None, id_column2: str | None) -> DataFrame:
        joined = pairs
        for n, (table, key) in (("1", (entities, id_column)), ("2", (entities2 if entities2 is not None else entities, id_column2 or id_column))):
            have = [c for c in wanted if c in table.columns]
            side = first_rows(table.select(key, *have, *([order_by] if order_by and order_by not in (key, *have) else [])), key, order_by)
            side = side.select(F.col(key).alias(f"_key{n}"), *[F.col(c).alias(f"{c}_{n}") for c in have])
            joined = joined.join(side, F.col(f"id{n}") == F.col(f"_key{n}"), "left").drop(f"_key{n}")
        return joined

    def _tally(self, found: MatchResult, classes: NameClasses, facts: DataFrame, columns: list[str], pairs: DataFrame, reasons: list[Column], scores: list[str]) -> tuple[int, int] | None:
        """How many pairs there are and pass. Rows that agree in their names and in the columns that rules read are one class, and
        a pair of classes stands for all its pairs of rows; an exact rule only lets classes meet that agree there. None if rules
        read ids or names as written, or tell the order of two rows apart."""
        own = [rule if isinstance(rule, Column) else rule() for rule in self.custom_rules.values()]
        if any(_needs(r, pairs, "id1", "id2", "name1", "name2") for r in own):
            return None
        more = [c for c in facts.columns if c != "_id" and c not in columns and any(_needs(r, pairs, f"{c}_1", f"{c}_2") for r in own)]
        read = columns + more
        rows = classes.rows.select(F.col("id").alias("_row"), F.col("name").alias("_name")).join(facts.select("_id", *read), F.col("_row") == F.col("_id"), "left")
        sized = materialize(rows.groupBy("_name", *read).agg(F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()), "classes")
        links = classes.links
        if classes.same is not None:
            links = links.union(sized.select("_name", F.col("_name").alias("b"), F.lit(classes.same)).distinct())
        links = materialize(links.where(score_rule(self.min_score).isNull()), "names")
        a, b = (sized.select(F.col("_name").alias(f"name_{x}"), *[F.col(f"`{c}`").alias(f"{c}_{i}") for c in [*read, "n", "c"]]) for i, x in ((1, "a"), (2, "b")))
        a = a.join(links, "name_a")
        block = next((c for c in columns if self.metadata_rules[c].get("operator", "exact") == "exact"), None)
        if block is None:
            met = spread(a, "name_b").join(b, "name_b")
        else:
            one, two = F.col(f"{block}_1"), F.col(f"{block}_2")
            met = spread(a, "name_b", f"{block}_1").join(b, (a["name_b"] == b["name_b"]) & (one == two)).drop(b["name_b"])
            for left, right in ((a.where(one.isNull()), b), (a.where(one.isNotNull()), b.where(two.isNull()))):
                met = met.unionByName(left.join(right, "name_b"))
        met = reduce(lambda df, c: _ratios(df, c, [facts]), scores, met.where("name_a <> name_b or c_1 <= c_2"))
        passes = reduce(lambda x, y: x & y, [r.isNull() for r in reasons])
        turned = [F.col(f"`{c}_{i}`").alias(f"{c}_{3 - i}") for c in read for i in (1, 2)]
        both = met.withColumn("ahead", passes).select("ahead", "n_1", "n_2", "c_1", "c_2", "similarity_score", *[f"_ratio_{c}" for c in scores], *turned).withColumn("back", passes)
        alone = F.col("c_1") == F.col("c_2")
        number = F.when(alone, F.expr("n_1 * (n_1 - 1) div 2")).otherwise(F.col("n_1") * F.col("n_2"))
        got = both.agg(F.coalesce(F.sum(F.when(F.col("ahead"), number)), F.lit(0)).alias("kept"), F.count_if(F.col("ahead") != F.col("back")).alias("mixed")).first()
        return None if got.mixed else (found.count(), got.kept)
