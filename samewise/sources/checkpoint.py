"""Checkpoints of pipeline stages: Parquet tables and a catalog of them.

Data goes to Parquet under a folder of any store that Spark reaches; the catalog is a JSON file beside each table
(FileCheckpointer) or an SQLite table on the driver (DatabaseCheckpointer, for folders of a local session only). A table is
written to a path of its own and becomes the checkpoint when its entry is put, by a rename, so a run that breaks off leaves
what was there before. A key is a stage and a fingerprint of the input and the
configuration, so a changed threshold does not find old pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sqlite3
import time
import uuid
from abc import ABC, abstractmethod
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.errors import CheckpointError
from samewise.sources.store import Store


def _local_default(spark: SparkSession) -> bool:
    return spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")


def fingerprint(df: DataFrame, columns: list[str], config: dict | None = None) -> str:
    """32 hex digits of the columns' rows, in any order, and of the configuration."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("x")).first()
    text = json.dumps([row.n, str(row.s), row.x, columns, config or {}], sort_keys=True, default=str)
    return hashlib.md5(text.encode()).hexdigest()


class BaseCheckpointer(ABC):
    """save, load and manage tables by stage and hash."""

    @staticmethod
    def validate_stage_name(stage: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", stage or ""):
            raise CheckpointError("stage names are letters, digits, _ and -", stage=stage)
        return stage

    @staticmethod
    def validate_data_hash(data_hash: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", data_hash or ""):
            raise CheckpointError("hashes are letters, digits, _ and -", data_hash=data_hash)
        return data_hash

    @classmethod
    def create_checkpoint_id(cls, stage: str, data_hash: str) -> str:
        return f"{cls.validate_stage_name(stage)}_{cls.validate_data_hash(data_hash)}"

    def __init__(self, spark: SparkSession, folder: str, compress: bool = True):
        # a path without scheme is one of the driver's working folder where the default store is the local disk
        self.spark, self.compress = spark, compress
        self.store = Store(spark, os.path.abspath(folder) if "://" not in folder and _local_default(spark) else folder)
        self.store.make()
        self.folder = self.store.folder

    def path(self, stage: str, data_hash: str) -> str:
        """A new path for the table."""
        return self.store.path(f"{self.create_checkpoint_id(stage, data_hash)}-{uuid.uuid4().hex}.parquet")

    def save(self, data: DataFrame, stage: str, data_hash: str, metadata: dict | None = None) -> dict:
        """Write a table (empty ones as well) and its catalog entry; the entry comes last and makes it valid."""
        path, before = self.path(stage, data_hash), self.get_metadata(stage, data_hash)
        try:
            data.write.mode("overwrite").option("compression", "snappy" if self.compress else "none").parquet(path)
            saved = self.spark.read.schema(data.schema).parquet(path)
            size = self.store.size(path)
            entry = {"stage": stage, "data_hash": data_hash, "timestamp": datetime.now().isoformat(), "rows": saved.count(), "columns": data.columns, "schema": data.schema.jsonValue(), "data_path": path, "file_size_bytes": size, "compressed": self.compress, "custom_metadata": metadata or {}}
            self._put(entry)
            if before:
                self.store.delete(before["data_path"])
            return entry
        except CheckpointError:
            raise
        except Exception as e:
            raise CheckpointError(f"checkpoint could not be saved: {e}", stage=stage) from e

    def load(self, stage: str, data_hash: str) -> DataFrame | None:
        """The table, or None if it is not there."""
        entry = self.get_metadata(stage, data_hash)
        if entry is None or not self.store.exists(entry["data_path"]):
            return None
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["data_path"])

    def exists(self, stage: str, data_hash: str) -> bool:
        return self.get_metadata(stage, data_hash) is not None

    def delete(self, stage: str, data_hash: str) -> bool:
        entry = self.get_metadata(stage, data_hash)
        if entry is None:
            return False
        self._drop(stage, data_hash)
        self.store.delete(entry["data_path"])
        return True

    def clear(self, data_hash: str | None = None) -> int:
        return sum(self.delete(e["stage"], e["data_hash"]) for e in self.list_checkpoints(data_hash))

    def cleanup_old_checkpoints(self, days_old: float = 7) -> int:
        limit = (datetime.now() - timedelta(days=days_old)).isoformat()
        return sum(self.delete(e["stage"], e["data_hash"]) for e in self.list_checkpoints() if e["timestamp"] < limit)

    def get_statistics(self) -> dict:
        all_ = self.list_checkpoints()
        times, sizes = [e["timestamp"] for e in all_], [e["file_size_bytes"] for e in all_]
        by_stage: dict[str, int] = {}
        for e in all_:
            by_stage[e["stage"]] = by_stage.get(e["stage"], 0) + 1
        return {
            "total_checkpoints": len(all_), "total_size_bytes": sum(sizes), "average_size_bytes": sum(sizes) / len(sizes) if sizes else 0, "unique_stages": len(by_stage),
            "unique_datasets": len({e["data_hash"] for e in all_}), "oldest_checkpoint": min(times, default=None), "newest_checkpoint": max(times, default=None),
            "compressed_checkpoints": sum(e["compressed"] for e in all_), "stages": by_stage,
        }

    def export_checkpoints(self, target: str, data_hash: str | None = None) -> int:
        """Copy tables and their entries to another folder, where a FileCheckpointer finds them."""
        found, there = self.list_checkpoints(data_hash), FileCheckpointer(self.spark, target, self.compress)
        for e in found:
            path = there.path(e["stage"], e["data_hash"])
            self.store.copy(e["data_path"], there.store, path)
            there._put({**e, "data_path": path})
        return len(found)

    @abstractmethod
    def _put(self, entry: dict) -> None: ...

    @abstractmethod
    def _drop(self, stage: str, data_hash: str) -> None: ...

    @abstractmethod
    def get_metadata(self, stage: str, data_hash: str) -> dict | None: ...

    @abstractmethod
    def list_checkpoints(self, data_hash: str | None = None) -> list[dict]:
        """Entries, newest first."""


class FileCheckpointer(BaseCheckpointer):
    """The catalog is a JSON file beside each table."""

    def _side(self, stage: str, data_hash: str) -> str:
        return self.create_checkpoint_id(stage, data_hash) + ".json"

    def _put(self, entry: dict) -> None:
        self.store.write(self._side(entry["stage"], entry["data_hash"]), json.dumps(entry))

    def _drop(self, stage: str, data_hash: str) -> None:
        self.store.delete(self._side(stage, data_hash))

    def get_metadata(self, stage: str, data_hash: str) -> dict | None:
        side = self._side(stage, data_hash)
        return json.loads(self.store.read(side)) if self.store.exists(side) else None

    def list_checkpoints(self, data_hash: str | None = None) -> list[dict]:
        out = [json.loads(self.store.read(n)) for n in self.store.names() if n.endswith(".json")]
        return sorted((e for e in out if data_hash in (None, e["data_hash"])), key=lambda e: e["timestamp"], reverse=True)


class DatabaseCheckpointer(BaseCheckpointer):
    """The catalog is an SQLite table on the driver; tables stay in Parquet."""

    def __init__(self, spark: SparkSession, folder: str, compress: bool = True, db_path: str | None = None):
        super().__init__(spark, folder, compress)
        if db_path is None and not self.folder.startswith("file:"):
            raise CheckpointError("the catalog of a folder that is not on this machine needs a db_path", folder=self.folder)
        self.db = sqlite3.connect(db_path or os.path.join("/" + self.folder.removeprefix("file:").lstrip("/"), "catalog.db"))
        self.db.execute("CREATE TABLE IF NOT EXISTS checkpoints (stage TEXT, data_hash TEXT, timestamp TEXT, entry TEXT, PRIMARY KEY (stage, data_hash))")
        self.db.execute("CREATE INDEX IF NOT EXISTS by_time ON checkpoints (timestamp)")

    def _put(self, entry: dict) -> None:
        with self.db:
            self.db.execute("INSERT OR REPLACE INTO checkpoints VALUES (?, ?, ?, ?)", (entry["stage"], entry["data_hash"], entry["timestamp"], json.dumps(entry)))

    def _drop(self, stage: str, data_hash: str) -> None:
        with self.db:
            self.db.execute("DELETE FROM checkpoints WHERE stage = ? AND data_hash = ?", (stage, data_hash))

    def get_metadata(self, stage: str, data_hash: str) -> dict | None:
        self.create_checkpoint_id(stage, data_hash)
        row = self.db.execute("SELECT entry FROM checkpoints WHERE stage = ? AND data_hash = ?", (stage, data_hash)).fetchone()
        return json.loads(row[0]) if row else None

    def list_checkpoints(self, data_hash: str | None = None) -> list[dict]:
        rows = self.db.execute("SELECT entry FROM checkpoints WHERE ? IS NULL OR data_hash = ? ORDER BY timestamp DESC", (data_hash, data_hash))
        return [json.loads(r[0]) for r in rows]

    def optimize_database(self) -> None:
        self.db.execute("VACUUM")
        self.db.execute("ANALYZE")


def checkpointer(spark: SparkSession, kind: str, folder: str, **options) -> BaseCheckpointer:
    from samewise.errors import ConfigurationError

    kinds = {"file": FileCheckpointer, "database": DatabaseCheckpointer}
    if kind not in kinds:
        raise ConfigurationError("checkpoint type is file or database", checkpoint_type=kind)
    return kinds[kind](spark, folder, **options)


def resume_or_save(store: BaseCheckpointer | None, stage: str, key: str, resume: bool, compute, metadata: dict | None = None) -> DataFrame:
    """The stage's table: from its checkpoint, or computed and saved."""
    if store is None:
        return compute()
    if resume and (found := store.load(stage, key)) is not None:
        return found
    started = time.time()
    store.save(compute(), stage, key, {**(metadata or {}), "seconds": round(time.time() - started, 3)})
    return store.load(stage, key)
