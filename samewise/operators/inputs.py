"""Checks of input tables: structure, entity rows, quality score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samewise.errors import DataValidationError
from samewise.functions.normalize import _WS, sanitize_columns
from samewise.operators.pairs import first_rows

MAX_NAME = 10_000


@dataclass
class CheckedInput:
    """The rows that pass, those that do not (with `reject_reason`), facts and warnings."""

    valid: DataFrame
    rejected: DataFrame
    metadata: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


@dataclass
class DeduplicationInput:
    """Settings of a run within a table: columns are stripped, extra ones made unique in their order."""

    id_column: str = "id"
    name_column: str = "name"
    threshold: float = 80.0
    additional_columns: list[str] = field(default_factory=list)
    min_entities: int = 2

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 100:
            raise DataValidationError("threshold lies between 0 and 100", threshold=self.threshold)
        self.additional_columns = list(dict.fromkeys(c.strip() for c in self.additional_columns if c.strip()))

    def check(self, df: DataFrame) -> CheckedInput:
        return validate_deduplication_input(df, self.id_column, self.name_column, self.threshold, self.min_entities, additional_columns=self.additional_columns)


@dataclass
class CrossDatasetInput:
    """Settings of a run between two tables; each side needs one entity, and its name columns must exist."""

    id_columns: tuple[str, str] = ("id", "id")
    name_columns1: list[str] = field(default_factory=lambda: ["name"])
    name_columns2: list[str] = field(default_factory=lambda: ["name"])
    threshold: float = 80.0

    def __post_init__(self) -> None:
        self.name_columns1, self.name_columns2 = (list(dict.fromkeys(c.strip() for c in cs if c.strip())) for cs in (self.name_columns1, self.name_columns2))
        if not self.name_columns1 or not self.name_columns2:
            raise DataValidationError("each side needs a name column")

    def check(self, df1: DataFrame, df2: DataFrame) -> tuple[CheckedInput, CheckedInput]:
        for df, i, names in ((df1, self.id_columns[0], self.name_columns1), (df2, self.id_columns[1], self.name_columns2)):
            validate_structure(df, [i, *names])
        return tuple(validate_deduplication_input(df, i, names[0], self.threshold, 1) for df, i, names in ((df1, self.id_columns[0], self.name_columns1), (df2, self.id_columns[1], self.name_columns2)))


def structure_counts(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows (column, rows, nulls): one per required column and one of null name for the table, from one pass over it.
    Missing columns raise."""
    if missing := [c for c in required if c not in df.columns]:
        raise DataValidationError(f"missing columns: {', '.join(missing)}", columns=df.columns)
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"nulls{i}") for i, c in enumerate(required)])
    per = [F.struct(F.lit(c).alias("column"), F.col("rows"), F.col(f"nulls{i}").alias("nulls")) for i, c in enumerate(required)]
    table = F.struct(F.lit(None).cast("string").alias("column"), F.col("rows"), F.lit(0).cast("long").alias("nulls"))
    return one.select(F.explode(F.array(table, *per)).alias("c")).select("c.*")


def validate_structure(df: DataFrame, required: list[str], min_rows: int = 1, max_rows: int | None = None, null_policy: str = "warn") -> list[str]:
    """Raise for missing columns and row counts out of bounds, and for nulls in required columns if null_policy is
    strict; 'warn' returns them, 'ignore' does not look. One pass over the table."""
    return _structure(df, required, min_rows, max_rows, null_policy)[1]


def _structure(df: DataFrame, required: list[str], min_rows: int = 1, max_rows: int | None = None, null_policy: str = "warn") -> tuple[int, list[str]]:
    """validate_structure, and the number of rows."""
    if null_policy not in ("strict", "warn", "ignore"):
        raise DataValidationError("null_policy is strict, warn or ignore", null_policy=null_policy)
    if max_rows is not None and max_rows < min_rows:
        raise DataValidationError("max_rows is below min_rows", min_rows=min_rows, max_rows=max_rows)
    counts = {r.column: r for r in structure_counts(df, required).collect()}
    n = counts[None].rows
    if n < min_rows or max_rows is not None and n > max_rows:
        raise DataValidationError("number of rows out of bounds", rows=n, min_rows=min_rows, max_rows=max_rows)
    nulls = [f"{c} has {counts[c].nulls} null values" for c in required if counts[c].nulls]
    if nulls and null_policy == "strict":
        raise DataValidationError("; ".join(nulls))
    return n, nulls if null_policy == "warn" else []


def reject_reason(entity_id: Column, name: Column) -> Column:
    """Why a row is no entity, null if it is one: id present and not blank, name with 1 to MAX_NAME characters once stripped."""
    plain = F.regexp_replace(name.cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    blank = F.regexp_replace(entity_id.cast("string"), _WS, "") == ""
    return F.when(entity_id.isNull() | F.coalesce(blank, F.lit(False)), "id is empty").when(name.isNull() | (plain == ""), "name is empty").when(F.length(plain) > MAX_NAME, "name is too long")


def quality_score(df: DataFrame, id_column: str = "id", name_column: str = "name") -> DataFrame:
    """One row data_quality_score: 0.3 filled + 0.3 distinct ids per row + 0.4 share of names that are neither blank nor
    over 1000 characters; 0 for an empty table."""
    i, n = F.col(id_column), F.col(name_column).cast("string")
    good = F.count_if((F.regexp_replace(n, _WS, "") != "") & (F.length(n) <= 1000))
    rows = F.count("*")
    filled = F.try_divide((F.count(i) + F.count(n)).cast("double"), 2 * rows)
    score = 0.3 * filled + 0.3 * F.try_divide(F.count_distinct(i).cast("double"), rows) + 0.4 * F.coalesce(F.try_divide(good.cast("double"), F.count(n)), F.lit(0.0))
    return df.agg(F.coalesce(score, F.lit(0.0)).alias("data_quality_score"))


def validate_entities(df: DataFrame, id_column: str = "id", name_column: str = "name") -> tuple[DataFrame, DataFrame]:
    """(valid rows with stripped names, rejected rows with reject_reason)."""
    marked = df.withColumn("reject_reason", reject_reason(F.col(id_column), F.col(name_column)))
    strip = F.regexp_replace(F.col(name_column).cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return marked.where("reject_reason is null").drop("reject_reason").withColumn(name_column, strip), marked.where("reject_reason is not null")


def validate_deduplication_input(df: DataFrame, id_column: str = "id", name_column: str = "name", threshold: float = 80.0, min_rows: int = 2, drop_duplicate_ids: bool = False, additional_columns: list[str] | tuple[str, ...] = ()) -> CheckedInput:
    """All checks for one table. Repeated ids give a warning; with drop_duplicate_ids one row of each is kept, that with
    the least name. additional_columns must exist; their nulls warn."""
    if not 0 <= threshold <= 100:
        raise DataValidationError("threshold lies between 0 and 100", threshold=threshold)
    columns = list(dict.fromkeys([id_column, name_column, *additional_columns]))
    n, warnings = _structure(df, columns, min_rows)
    valid, rejected = validate_entities(df, id_column, name_column)
    facts = valid.agg(F.count("*").alias("n"), F.count_distinct(id_column).alias("ids")).first()
    if not facts.n:
        raise DataValidationError("no valid entity", rows=n)
    if facts.ids < facts.n:
        warnings.append(f"{facts.n - facts.ids} rows repeat an id")
        if drop_duplicate_ids:
            valid = first_rows(valid, id_column, name_column)
    valid = sanitize_columns(valid, [name_column])
    meta = {"original_row_count": n, "columns_validated": columns, "final_row_count": facts.ids if drop_duplicate_ids else facts.n, "validation_warnings": warnings, "data_quality_score": quality_score(valid, id_column, name_column).first()[0]}
    return CheckedInput(valid, rejected, meta, warnings)


def validate_cross_dataset_input(df1: DataFrame, df2: DataFrame, id1: str, id2: str, name1: str, name2: str, threshold: float = 80.0) -> tuple[CheckedInput, CheckedInput]:
    return validate_deduplication_input(df1, id1, name1, threshold), validate_deduplication_input(df2, id2, name2, threshold)


def cross_input_metadata(one: CheckedInput, two: CheckedInput) -> dict:
    """What the checks of two tables tell of both: rows before and after, scores, and the warnings of the first, then the second."""
    sides = {f"df{i}_{new}": side.metadata[key] for new, key in (("original_rows", "original_row_count"), ("final_rows", "final_row_count"), ("quality_score", "data_quality_score")) for i, side in ((1, one), (2, two))}
    return {**sides, "validation_warnings": [*one.warnings, *two.warnings]}
