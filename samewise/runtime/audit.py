"""Audit entries of a driver process."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession

from samewise.functions.normalize import sanitize_value


def audit_entry(action: str, details: dict) -> dict:
    """An entry with a time, and its texts sanitised; a name beyond 100 characters or a value beyond 1000 raises, so that
    nothing goes missing from the record."""
    clean = {sanitize_value(str(k), max_length=100): sanitize_value(str(v), max_length=1000) for k, v in details.items()}
    return {"timestamp": datetime.now(UTC).isoformat(), "action": sanitize_value(action, max_length=100), "details": clean, "sanitized": True}


def append_audit(spark: SparkSession, entries: list[dict], path: str) -> None:
    """Add entries to an audit table (Parquet)."""
    spark.createDataFrame(entries, "timestamp string, action string, details map<string,string>, sanitized boolean").write.mode("append").parquet(path)
