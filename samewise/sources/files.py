"""Tables and configuration from and to files, by suffix."""

from __future__ import annotations

import json
import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from samewise.errors import ConfigurationError, DataValidationError
from samewise.functions.normalize import clean_for_excel
from samewise.sources.store import exists

SAMPLE_CONFIG = {
    "matching": {"threshold": 85.0, "scorer": "token_sort_ratio", "max_matches_per_entity": 100},
    "validation": {"type": "rules", "rules": {"min_score": 90.0}},
    "pipeline": {"checkpoint": True, "checkpoint_dir": ".samewise_checkpoints"},
}


def load_data(spark: SparkSession, path: str, schema: StructType | str | None = None, **options) -> DataFrame:
    """CSV (header; columns are strings unless a schema or inferSchema is given), JSON lines or arrays, column-oriented
    JSON (orient='columns'), Parquet, ORC, Excel. A missing path raises FileNotFoundError, another suffix ValueError."""
    kind = PurePosixPath(path).suffix.lower()
    if not any(c in path for c in "*?[{") and not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == ".csv":
        return reader.options(header=True, escape='"', multiLine=True, **options).csv(path)
    if kind in (".json", ".jsonl"):
        if options.pop("orient", None) == "columns":
            import pandas as pd

            return spark.createDataFrame(pd.read_json(path))
        return reader.options(**options).json(path)
    if kind in (".parquet", ".orc"):
        return getattr(reader.options(**options), kind[1:])(path)
    if kind in (".xlsx", ".xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, **options), schema)
    raise DataValidationError(f"unknown file type {kind}", path=path)


def save_data(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """Write by suffix; Excel files are made on the driver and hold what one sheet can."""
    kind = PurePosixPath(path).suffix.lower()
    writer = df.write.mode(mode).options(**options)
    if kind == ".csv":
        writer.options(header=True, escape='"').csv(path)
    elif kind in (".json", ".jsonl"):
        writer.json(path)
    elif kind in (".parquet", ".orc"):
        getattr(writer, kind[1:])(path)
    elif kind in (".xlsx", ".xls"):
        save_sheets({"Sheet1": df}, path, clean=False)
    else:
        raise DataValidationError(f"unknown file type {kind}", path=path)


def save_sheets(sheets: dict[str, DataFrame], path: str, clean: bool = True) -> None:
    """An Excel file of several sheets, cleaned of control characters. A sheet holds at most 1,048,575 rows, and its name 31
    characters, of which none is told by case; more rows, longer names and names that clash raise."""
    import pandas as pd

    if max(map(len, sheets), default=0) > 31 or len({n.lower() for n in sheets}) < len(sheets):
        raise DataValidationError("names of sheets differ in more than case and have 31 characters at most", sheets=list(sheets))

    if parent := os.path.dirname(path):
        os.makedirs(parent, exist_ok=True)
    with pd.ExcelWriter(path) as writer:
        for name, df in sheets.items():
            rows = (clean_for_excel(df) if clean else df).limit(1_048_576).toPandas()
            if len(rows) > 1_048_575:
                raise DataValidationError("too many rows for a sheet", sheet=name)
            rows.to_excel(writer, sheet_name=name, index=False)


def load_config(path: str) -> dict:
    kind = PurePosixPath(path).suffix.lower()
    with open(path) as f:
        if kind == ".json":
            return json.load(f)
        if kind in (".yaml", ".yml"):
            import yaml

            return yaml.safe_load(f) or {}
    raise ConfigurationError(f"unknown configuration type {kind}", path=path)


def save_config(config: dict, path: str) -> None:
    kind = PurePosixPath(path).suffix.lower()
    if kind not in (".json", ".yaml", ".yml"):
        raise ConfigurationError(f"unknown configuration type {kind}", path=path)
    with open(path, "w") as f:
        if kind == ".json":
            json.dump(config, f, indent=2)
        else:
            import yaml

            yaml.safe_dump(config, f, sort_keys=False)


def create_sample_config(path: str) -> dict:
    save_config(SAMPLE_CONFIG, path)
    return SAMPLE_CONFIG
