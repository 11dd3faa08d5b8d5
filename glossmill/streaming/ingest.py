"""Incremental ingest of memory rows: each micro-batch is folded to its newest rows and merged as a new generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.memo import latest


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Append the newest row of each key of a batch under its batch number; a batch that is run again overwrites its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str, keys: list[str], order: list[str]) -> DataFrame:
    return latest(spark.read.parquet(path).drop("batch"), keys, order)
