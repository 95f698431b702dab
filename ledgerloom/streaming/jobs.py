"""Jobs that wait their turn: caps for each actor and organisation, release when a job ends, expiry when it doesn't; and the stage that a job goes through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

RESULT = "org {org}, job_id {job}, at long, what string"
WAITING = ("ms", "turn", "job_id", "actor", "kind")
SLOT, HELD = 3_600_000, 100_000  # milliseconds of a slot; rows of a batch that are held before they are put to their slots


@dataclass(frozen=True)
class Caps:
    """Unfinished jobs of an actor and of an organisation at most, and the seconds after which a job that has not ended is given up."""

    per_actor: int = 1
    per_org: int = 5
    seconds: int = 300


@dataclass
class Desk:
    """The unfinished jobs of one organisation: (job, actor, submitted at, in milliseconds), oldest first."""

    caps: Caps
    pending: list[tuple[Any, Any, int]] = field(default_factory=list)

    def sweep(self, now: int) -> list[tuple[Any, int, str]]:
        """Jobs given up before ``now``, each at the moment its time was over."""
        over = [(job, at + 1000 * self.caps.seconds, "expired") for job, _, at in self.pending if now - at > 1000 * self.caps.seconds]
        self.pending = self.pending[len(over) :]  # the oldest ones
        return over

    def take(self, at: int, kind: str, job: Any, actor: Any) -> list[tuple[Any, int, str]]:
        """What a submission (``submit``) or an end (``finish``) leads to, after what has expired by then."""
        out = self.sweep(at)
        if kind == "finish":
            left = [p for p in self.pending if p[0] != job]
            what = "unknown" if len(left) == len(self.pending) else "released"
            self.pending = left
        elif sum(p[1] == actor for p in self.pending) >= self.caps.per_actor:
            what = "actor_pending"
        elif len(self.pending) >= self.caps.per_org:
            what = "organization_pending"
        else:
            what = "accepted"
            self.pending.append((job, actor, at))
        return [*out, (job, at, what)]


def _rows(events: DataFrame, org: str, actor: str, job: str, kind: str, at: str) -> DataFrame:
    """org, ms, turn (ends before submissions of one moment), job_id, actor, kind and the time itself, which a stream's watermark follows."""
    ms = F.unix_millis(F.col(at))
    return events.select(F.col(org).alias("org"), ms.alias("ms"), F.when(F.col(kind) == "finish", 0).otherwise(1).alias("turn"), F.col(job).alias("job_id"), F.col(actor).alias("actor"), F.col(kind).alias("kind"), F.col(at).alias("time"))


def job_log(events: DataFrame, caps: Caps = Caps(), org: str = "org", actor: str = "actor", job: str = "job_id", kind: str = "kind", at: str = "at", late: int = 0) -> DataFrame:
    """org, job_id, at and what became of every submission and end: accepted, actor_pending, organization_pending, released, unknown, expired.

    An organisation's rows are walked in order of time (ends first, then by job) up to ``late`` seconds before the last row of all, as a stream with that watermark has done
    at its end. Rows with a null time are left out. Caps are serial by nature: a task walks an organisation, its state is the unfinished jobs; Spark does the sorting.
    """
    rows = _rows(events, org, actor, job, kind, at).drop("time").where("ms IS NOT NULL")
    end = rows.agg(F.max("ms")).first()[0]
    kinds = dict(rows.dtypes)
    schema = RESULT.format(org=kinds["org"], job=kinds["job_id"])
    if end is None:
        return events.sparkSession.createDataFrame([], schema)
    until = end - 1000 * late
    rows = rows.where(F.col("ms") <= until).repartition("org").sortWithinPartitions("org", "ms", "turn", "job_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, desk = object(), Desk(caps)
        for pdf in batches:
            out = []
            for o, ms, k, j, a in pdf[["org", "ms", "kind", "job_id", "actor"]].itertuples(index=False):
                if o != last and not (o is None and last is None):
                    out += [(last, *x) for x in desk.sweep(until)]
                    last, desk = o, Desk(caps)
                out += [(o, *x) for x in desk.take(ms, k, j, a)]
            yield pd.DataFrame([(o, j, ms, w) for o, j, ms, w in out], columns=["org", "job_id", "at", "what"])
        yield pd.DataFrame([(last, *x) for x in desk.sweep(until)], columns=["org", "job_id", "at", "what"])

    return rows.mapInPandas(walk, schema)


class JobProcessor(StatefulProcessor):
    """An organisation's desk under Structured Streaming.

    Rows wait until the watermark has passed them, so that they are taken in order of time whatever batch brought them. They wait by the hour (``SLOT``), in pieces of what a batch
    brought, and only one hour's rows are in memory at a time. A timer stands at the next moment at which something is due: a waiting row, or the end of an unfinished job's time.
    """

    def __init__(self, caps: Caps, rows: T.StructType):
        self.caps = caps
        self.of_rows = T.StructType([T.StructField(c, T.ArrayType(rows[c].dataType)) for c in WAITING])
        self.of_pending = T.StructType([rows[c] for c in ("job_id", "actor", "ms")])
        self.whole = {c for c in WAITING if isinstance(rows[c].dataType, T.IntegralType)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, piece long", self.of_rows)
        self.slots = handle.getMapState("slots", "slot long", "pieces long, first long")
        self.pending = handle.getListState("pending", self.of_pending)

    def _keep(self, new: pd.DataFrame, slots: dict[int, tuple[int, int]]) -> None:
        """Rows as one more piece of each slot; ``slots``: pieces and the first moment of each."""
        for slot, part in new.groupby(new["ms"] // SLOT):
            pieces, first = slots.get(int(slot), (0, int(part["ms"].min())))
            values = [[None if pd.isna(v) else int(v) if c in self.whole else v for v in part[c].tolist()] for c in WAITING]
            self.waiting.updateValue((int(slot), pieces), tuple(values))
            slots[int(slot)] = (pieces + 1, min(first, int(part["ms"].min())))

    def _work(self, key: tuple, new: Iterator[pd.DataFrame], watermark: int) -> Iterator[pd.DataFrame]:
        slots = {k[0]: tuple(v) for k, v in self.slots.iterator()}
        before, held = dict(slots), []
        for pdf in new:
            held.append(pdf[list(WAITING)])
            if sum(map(len, held)) >= HELD:
                self._keep(pd.concat(held), slots)
                held = []
        if held:
            self._keep(pd.concat(held), slots)
        desk = Desk(self.caps, [tuple(p) for p in self.pending.get()])
        for slot in sorted(slots):
            pieces, first = slots[slot]
            if first > watermark:
                break
            rows = sorted((r for n in range(pieces) for r in zip(*self.waiting.getValue((slot, n)))), key=lambda r: (r[0], r[1], r[2]))
            due = [r for r in rows if r[0] <= watermark]
            out = [x for ms, _, job, actor, kind in due for x in desk.take(ms, kind, job, actor)]
            for n in range(pieces):
                self.waiting.removeKey((slot, n))
            del slots[slot]
            if len(due) < len(rows):
                self._keep(pd.DataFrame(rows[len(due) :], columns=list(WAITING), dtype=object), slots)
            yield from self._told(key, out)
        yield from self._told(key, desk.sweep(watermark))
        for slot in before.keys() - slots.keys():
            self.slots.removeKey((slot,))
        for slot, now in slots.items():
            if before.get(slot) != now:
                self.slots.updateValue((slot,), now)
        if desk.pending:
            self.pending.put(desk.pending)
        else:
            self.pending.clear()
        soon = [first for _, (_, first) in sorted(slots.items())[:1]] + [p[2] + 1000 * self.caps.seconds + 1 for p in desk.pending[:1]]
        if soon:
            self.handle.registerTimer(max(min(soon), watermark + 1))

    @staticmethod
    def _told(key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["org", "job_id", "at", "what"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        yield from self._work(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._work(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def job_stream(events: DataFrame, caps: Caps = Caps(), org: str = "org", actor: str = "actor", job: str = "job_id", kind: str = "kind", at: str = "at", late: int = 600) -> DataFrame:
    """``job_log`` over a stream. Rows more than ``late`` seconds behind the latest one are dropped; needs the RocksDB state store."""
    timed = events.withWatermark(at, f"{late} seconds")
    rows = _rows(timed, org, actor, job, kind, at).where("ms IS NOT NULL")
    kinds = dict(rows.dtypes)
    processor = JobProcessor(caps, rows.schema)
    return rows.groupBy("org").transformWithStateInPandas(processor, RESULT.format(org=kinds["org"], job=kinds["job_id"]), "Append", "EventTime")


# --- what a job goes through -------------------------------------------------------------------------------------------------------------


def staged(jobs: DataFrame, today: Column, kinds: dict[str, str]) -> DataFrame:
    """job_id, outcome, amount, transaction_date: the first check that a job fails, else 'proposed' for the day on which it is processed.

    ``jobs``: job_id, declared_size, declared_type, body (binary), amount (text). A body has as many bytes as declared and begins as files of its type do (``kinds``: hexadecimal
    beginnings by type); an amount is a number other than zero. What is null fails its check.
    """
    head = F.hex(F.substring("body", 1, 16))
    known = F.lit(False)
    for name, start in kinds.items():
        known = known | ((F.col("declared_type") == name) & head.startswith(start.upper()))
    amount = F.replace(F.trim("amount"), F.lit(","), F.lit("")).try_cast("decimal(20,2)")
    checks = [("size_mismatch", F.octet_length("body") == F.col("declared_size")), ("type_mismatch", known), ("amount_denied", amount != 0)]
    outcome = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks], F.lit("proposed"))
    return jobs.select("job_id", outcome.alias("outcome"), F.when(outcome == "proposed", amount).alias("amount"), F.when(outcome == "proposed", today).alias("transaction_date"))


def stage_stream(jobs: DataFrame, path: str, kinds: dict[str, str], checkpoint: str, today: Column | None = None) -> Any:
    """A query that stages the jobs of each trigger; a batch that is run again writes the same folder again. Started with availableNow."""

    def write(batch: DataFrame, number: int) -> None:
        day = F.lit(datetime.now(timezone.utc).date()) if today is None else today
        staged(batch, day, kinds).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return jobs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
