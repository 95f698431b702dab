"""Hash chains over audit events: appending is serial within a scope, verifying is not."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def canonical(columns: list[str]) -> Column:
    """JSON of the columns in the order of their names, nulls kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def append(events: DataFrame, scope: str, order: str, payload: list[str], heads: DataFrame | None = None) -> DataFrame:
    """Scope, order, payload, sequence_number, previous_hash and event_hash; each hash covers the one before.

    A scope goes on from its row in ``heads`` (scope, sequence_number, event_hash), if it has one. A scope is walked in one task, in order; state is one hash. Rows of a scope are
    sorted by Spark, not in memory of the task.
    """
    kinds = dict(events.dtypes)
    rows = events.select(scope, order, *payload, canonical(payload).alias("_body"))
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in (scope, order, *payload))
    if heads is None:
        rows = rows.withColumn("_number", F.lit(0).cast("long")).withColumn("_hash", F.lit(GENESIS))
    else:
        last = heads.select(F.col(scope).alias("_s"), F.col("sequence_number").alias("_at"), F.col("event_hash").alias("_head"))
        rows = rows.join(last, F.col(scope).eqNullSafe(F.col("_s")), "left")
        rows = rows.select(scope, order, *payload, "_body", F.coalesce("_at", F.lit(0).cast("long")).alias("_number"), F.coalesce("_head", F.lit(GENESIS)).alias("_hash"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_scope, previous, number = object(), GENESIS, 0
        for batch in batches:
            seq, before, made = [], [], []
            n = batch.num_columns
            for s, body, at, head in zip(*[batch.column(k).to_pylist() for k in (0, n - 3, n - 2, n - 1)]):
                if s != last_scope:
                    last_scope, previous, number = s, head, at
                number += 1
                seq.append(number)
                before.append(previous)
                previous = hashlib.sha256(f"{number}|{previous}|{body}".encode()).hexdigest()
                made.append(previous)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(seq, pa.int64()), pa.array(before, pa.string()), pa.array(made, pa.string())], names=[*batch.schema.names[:-3], "sequence_number", "previous_hash", "event_hash"])

    return rows.repartition(scope).sortWithinPartitions(scope, order).mapInArrow(walk, f"{fields}, sequence_number long, previous_hash string, event_hash string")


def heads_of(chained: DataFrame, scope: str) -> DataFrame:
    """scope, sequence_number and event_hash of each scope's last event."""
    last = F.max(F.struct("sequence_number", "event_hash"))
    return chained.groupBy(scope).agg(last.alias("_h")).select(scope, "_h.sequence_number", "_h.event_hash")


def verify(chained: DataFrame, scope: str, payload: list[str], heads: DataFrame | None = None) -> DataFrame:
    """scope, n, ok, failed_at and code: the first failure of each scope (gap, previous_hash, event_hash), all rows checked on their own.

    With ``heads`` (as ``heads_of`` gave them when the events were written) a scope whose last event is not the recorded one fails as 'head', at its last row: events are missing
    at the end, or all of them were made anew. A scope of ``heads`` without events fails at 0.
    """
    by = Window.partitionBy(scope).orderBy("sequence_number")
    again = F.sha2(F.concat_ws("|", F.col("sequence_number").cast("string"), F.col("previous_hash"), canonical(payload)), 256)
    rows = chained.select(scope, "sequence_number", "previous_hash", "event_hash", again.alias("_again"))
    rows = rows.withColumns({"_lag": F.coalesce(F.lag("event_hash").over(by), F.lit(GENESIS)), "_n": F.row_number().over(by)})
    code = F.when(F.col("sequence_number") != F.col("_n"), "gap").when(~F.col("previous_hash").eqNullSafe(F.col("_lag")), "previous_hash").when(~F.col("event_hash").eqNullSafe(F.col("_again")), "event_hash")
    bad = rows.withColumn("_code", code)
    first = F.min(F.when(F.col("_code").isNotNull(), F.struct("_n", "_code")))
    out = bad.groupBy(scope).agg(F.count("*").alias("n"), first.alias("_f"), F.max(F.struct("sequence_number", "event_hash")).alias("_h"))
    if heads is not None:
        kept = heads.select(F.col(scope).alias("_s"), F.struct("sequence_number", "event_hash").alias("_kept"), F.lit(True).alias("_known"))
        out = out.join(kept, F.col(scope).eqNullSafe(F.col("_s")), "full").withColumn(scope, F.when(F.col("n").isNull(), F.col("_s")).otherwise(F.col(scope))).fillna(0, ["n"])
        other = F.struct(F.col("n").cast("int").alias("_n"), F.lit("head").alias("_code"))
        out = out.withColumn("_f", F.coalesce("_f", F.when(~F.col("_h").eqNullSafe(F.col("_kept")), other)))
    return out.select(scope, "n", F.col("_f").isNull().alias("ok"), F.col("_f._n").cast("long").alias("failed_at"), F.col("_f._code").alias("code"))
