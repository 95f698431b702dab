"""Limits over event streams: age, rate, time to live, lockout.

Batch forms take any DataFrame of events; the stateful forms run under Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def too_old_or_early(event_time: Column, now: Column, age: int = 120, ahead: int = 30) -> Column:
    """Whether an event is older than ``age`` or further than ``ahead`` seconds in the future."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(event_time)
    return (seconds > age) | (seconds < -ahead)


def expired(submitted: Column, now: Column, seconds: int = 300) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(submitted) > seconds


def decide(times: list[float], recent: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Whether each attempt (ascending) is let through, and the accepted times that still count. Refused attempts do not count."""
    out = []
    for t in times:
        recent = [x for x in recent if x > t - seconds]
        ok = len(recent) < most
        if ok:
            recent.append(t)
        out.append(ok)
    return out, recent


def rate_limit(events: DataFrame, actor: str = "actor", time: str = "ts", event: str = "event_id", most: int = 5, seconds: int = 60) -> DataFrame:
    """event, actor, ts, accepted: at most ``most`` accepted events of an actor in any ``seconds``.

    An actor's events are sorted by Spark and walked in batches; the state is at most ``most`` times.
    """
    kinds = dict(events.dtypes)
    rows = events.select(event, actor, time).repartition(actor).sortWithinPartitions(actor, time, event)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: Any = object()
        recent: list[float] = []
        for pdf in batches:
            out = []
            seconds_ = pd.to_datetime(pdf[time]).astype("datetime64[ns]").astype("int64") / 1e9
            for who, at in zip(pdf[actor].astype(object).where(pdf[actor].notna(), None), seconds_):
                if who != last:
                    last, recent = who, []
                ok, recent = decide([at], recent, most, seconds)
                out += ok
            yield pdf.assign(accepted=out)

    return rows.mapInPandas(walk, f"`{event}` {kinds[event]}, `{actor}` {kinds[actor]}, `{time}` {kinds[time]}, accepted boolean")


def rate_limit_stream(events: DataFrame, actor: str = "actor", time: str = "ts", event: str = "event_id", most: int = 5, seconds: int = 60) -> DataFrame:
    """The same over a stream, in the order of event time within each trigger; an actor's state goes when it has been quiet for ``seconds``."""
    kinds = dict(events.dtypes)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(frames)).sort_values([time, event])
        times = (pd.to_datetime(pdf[time]).astype("datetime64[ns]").astype("int64") / 1e9).tolist()
        ok, recent = decide(times, recent, most, seconds)
        state.update((recent,))
        state.setTimeoutDuration(seconds * 1000)
        yield pdf[[event, actor, time]].assign(accepted=ok)

    schema = f"`{event}` {kinds[event]}, `{actor}` {kinds[actor]}, `{time}` {kinds[time]}, accepted boolean"
    return events.groupBy(actor).applyInPandasWithState(step, schema, "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def pending_caps(events: DataFrame, per_actor: int = 1, per_org: int = 5, actor: str = "actor", org: str = "org", start: str = "started", end: str = "finished", key: str = "job_id") -> DataFrame:
    """key, accepted, reason of jobs in the order of their start: an actor has ``per_actor`` and an organisation ``per_org`` unfinished jobs at most."""
    kinds = dict(events.dtypes)
    rows = events.select(key, actor, org, start, end).repartition(org).sortWithinPartitions(org, start, key)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: Any = object()
        running: list[tuple] = []
        for pdf in batches:
            why: list[str | None] = []
            for a, o, s, e in zip(pdf[actor], pdf[org], pdf[start], pdf[end]):
                if o != last:
                    last, running = o, []
                running = [r for r in running if r[1] > s]
                if sum(r[0] == a for r in running) >= per_actor:
                    why.append("actor_pending")
                elif len(running) >= per_org:
                    why.append("organization_pending")
                else:
                    running.append((a, e))
                    why.append(None)
            yield pd.DataFrame({key: pdf[key], "accepted": [w is None for w in why], "reason": why})

    return rows.mapInPandas(walk, f"`{key}` {kinds[key]}, accepted boolean, reason string")


def lockouts(events: DataFrame, failed: Column, succeeded: Column, actor: str = "actor", time: str = "ts", event: str = "event_id", most: int = 5, seconds: int = 1800) -> DataFrame:
    """event, actor, failures, locked for each failure: failures in a row, each within ``seconds`` of the one before and no success between."""
    by = Window.partitionBy(actor).orderBy(time, event)
    rows = events.select(event, actor, time, failed.alias("_f"), succeeded.alias("_s")).where("_f OR _s")
    gap = F.unix_timestamp(time) - F.unix_timestamp(F.lag(time).over(by)) > seconds
    rows = rows.withColumn("_new", F.when(F.col("_s") | F.coalesce(gap, F.lit(True)) | F.coalesce(F.lag("_s").over(by), F.lit(True)), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_new").over(by))
    within = Window.partitionBy(actor, "_run").orderBy(time, event)
    return rows.where("_f").withColumn("failures", F.row_number().over(within)).select(event, actor, "failures", (F.col("failures") >= most).alias("locked"))


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: re-delivered events go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, keys: list[str], length: str = "10 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts per key and tumbling or sliding window; on a stream, ``late`` sets the watermark."""
    rows = events.withWatermark(time, late) if late and events.isStreaming else events
    return rows.groupBy(F.window(time, length, slide) if slide else F.window(time, length), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
