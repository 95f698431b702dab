"""The audit chain over a stream: each trigger's events are appended to the chains of their scopes, once, whatever is delivered again."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain
from .limits import deduplicated


def _number(path: str) -> int:
    return int(path.rstrip("/").rsplit("=", 1)[1])


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Folders ``batch=n`` under ``path``, by number."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    return sorted((str(s.getPath()) for s in system.listStatus(folder) if s.getPath().getName().startswith("batch=")), key=_number)


def append_batch(batch: DataFrame, number: int, path: str, scope: str, order: str, payload: list[str]) -> None:
    """The events of one trigger, chained to what earlier triggers left: ``events/batch=n``, and ``heads/batch=n`` with the last event of every scope so far.

    Both are written as a whole, so that a trigger that runs again after a failure writes the same again: it goes on from the heads of the triggers before it.
    """
    spark = batch.sparkSession
    earlier = [p for p in _batches(spark, f"{path}/heads") if _number(p) < number]
    heads = spark.read.parquet(earlier[-1]) if earlier else None
    chain.append(batch, scope, order, payload, heads).write.mode("overwrite").parquet(f"{path}/events/batch={number}")
    new = chain.heads_of(spark.read.parquet(f"{path}/events/batch={number}"), scope)
    if heads is not None:
        new = heads.join(new, heads[scope].eqNullSafe(new[scope]), "left_anti").unionByName(new)
    new.write.mode("overwrite").parquet(f"{path}/heads/batch={number}")


def audit_stream(events: DataFrame, path: str, scope: str, order: str, payload: list[str], key: str, time: str, checkpoint: str, late: str = "10 minutes") -> Any:
    """A query that chains a stream of events. Those delivered again within the watermark go. Started with availableNow."""

    def write(batch: DataFrame, number: int) -> None:
        append_batch(batch, number, path, scope, order, payload)

    return deduplicated(events, key, time, late).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chain(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All events and the heads of the last trigger."""
    return spark.read.parquet(f"{path}/events").drop("batch"), spark.read.parquet(_batches(spark, f"{path}/heads")[-1])
