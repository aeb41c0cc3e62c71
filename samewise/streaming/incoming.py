"""Matching micro-batches of new entities against a reference table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from samewise.operators.match import FuzzyMatcher


def match_stream(stream: DataFrame, reference: DataFrame, matcher: FuzzyMatcher, out: str, checkpoint: str, id1: str = "id", id2: str = "id", name1: str = "name", name2: str = "name") -> StreamingQuery:
    """Write the cross matches of every micro-batch to Parquet, one folder per batch, so that a batch that is
    repeated after a failure replaces its own result."""

    def one(batch: DataFrame, number: int) -> None:
        found = matcher.find_cross_matches(batch, reference, id1, id2, name1, name2)
        found.pairs.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
