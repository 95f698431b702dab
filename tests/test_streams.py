"""Streams in several batches, out of order and with repeats, against their batch forms and plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import chain
from ledgerloom.streaming import audit, jobs
from ledgerloom.streaming.shared import rocksdb

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "org string, actor long, job_id long, kind string, at timestamp"


def job_rows():
    rng, rows = random.Random(3), []
    for j in range(160):
        at = T0 + timedelta(seconds=20 * j + rng.randrange(15))
        org = rng.choice(["a", "a", "b", None])
        rows.append((org, rng.randrange(4), j, "submit", at))
        if rng.random() < 0.6:
            rows.append((org, 0, j, "finish", at + timedelta(seconds=rng.choice([0, 30, 100, 400]))))
    return rows


def plain(rows, caps, late):
    until = max(r[4] for r in rows) - timedelta(seconds=late)
    out = []
    for org in {r[0] for r in rows}:
        live = {}
        for _, actor, job, kind, at in sorted((r for r in rows if r[0] == org and r[4] <= until), key=lambda r: (r[4], r[3] != "finish", r[2])):
            for j, (_, since) in list(live.items()):
                if at - since > timedelta(seconds=caps.seconds):
                    del live[j]
                    out.append((org, j, since + timedelta(seconds=caps.seconds), "expired"))
            if kind == "finish":
                what = "released" if live.pop(job, None) else "unknown"
            elif sum(a == actor for a, _ in live.values()) >= caps.per_actor:
                what = "actor_pending"
            elif len(live) >= caps.per_org:
                what = "organization_pending"
            else:
                what, live[job] = "accepted", (actor, at)
            out.append((org, job, at, what))
        out += [(org, j, since + timedelta(seconds=caps.seconds), "expired") for j, (_, since) in live.items() if until - since > timedelta(seconds=caps.seconds)]
    return sorted(((o or "", j, round(t.timestamp() * 1000), w) for o, j, t, w in out))


def test_job_stream(spark, tmp_path):
    """Four files, rows of one out of order with the next by less than the watermark's delay."""
    rows, caps = job_rows(), jobs.Caps(per_actor=1, per_org=2, seconds=120)
    shuffled = sorted(rows, key=lambda r: r[4] + timedelta(seconds=random.Random(r[2]).randrange(200)))
    size = -(-len(shuffled) // 4)
    for k in range(4):
        part = spark.createDataFrame(shuffled[k * size : (k + 1) * size], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with rocksdb(spark):
        jobs.job_stream(source, caps, late=600).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted((r.org or "", r.job_id, r.at, r.what) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = plain(rows, caps, 600)
    assert got == want
    batch = jobs.job_log(spark.createDataFrame(rows, SCHEMA).repartition(3), caps, late=600)
    assert sorted((r.org or "", r.job_id, r.at, r.what) for r in batch.collect()) == want
    assert {w for *_, w in want} == {"accepted", "actor_pending", "organization_pending", "released", "unknown", "expired"}
    assert jobs.job_log(spark.createDataFrame([], SCHEMA), caps).collect() == []


def test_audit_stream(spark, tmp_path):
    rows = [(k, f"s{k % 3}", T0 + timedelta(minutes=k), f"v{k}") for k in range(60)]
    schema, payload = "event_id long, scope string, ts timestamp, v string", ["v"]
    for k in range(3):  # the second and third deliveries bring some events again
        again = rows[max(0, 20 * k - 4) : 20 * k] if k else []
        spark.createDataFrame(again + rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        audit.audit_stream(source, f"{tmp_path}/out", "scope", "event_id", payload, "event_id", "ts", f"{tmp_path}/state").awaitTermination()
    chained, heads = audit.read_chain(spark, f"{tmp_path}/out")
    whole = chain.append(spark.createDataFrame(rows, schema), "scope", "event_id", payload)
    fields = ("scope", "sequence_number", "event_id", "previous_hash", "event_hash")
    assert sorted(tuple(r[c] for c in fields) for r in chained.collect()) == sorted(tuple(r[c] for c in fields) for r in whole.collect())
    # A trigger that runs again writes the same.
    before = sorted(map(tuple, heads.collect()))
    batch = spark.createDataFrame(rows[40:], schema)
    last = max(audit._number(p) for p in audit._batches(spark, f"{tmp_path}/out/heads"))
    only = spark.read.parquet(f"{tmp_path}/out/events/batch={last}")
    if only.count():
        batch = batch.join(only.select("event_id"), "event_id", "left_semi").select(*batch.columns)
        audit.append_batch(batch, last, f"{tmp_path}/out", "scope", "event_id", payload)
        chained, heads = audit.read_chain(spark, f"{tmp_path}/out")
        assert sorted(map(tuple, heads.collect())) == before and chained.count() == 60
    assert all(r.ok for r in chain.verify(chained, "scope", payload, heads).collect())
    short = chain.verify(chained.where("event_id < 57"), "scope", payload, heads)
    assert {r.scope: (r.ok, r.failed_at, r.code) for r in short.collect()} == {f"s{k}": (False, 19, "head") for k in range(3)}
    gone = {r.scope: (r.n, r.ok, r.failed_at, r.code) for r in chain.verify(chained.where("scope <> 's0'"), "scope", payload, heads).collect()}
    assert gone["s0"] == (0, False, 0, "head") and gone["s1"][1]


def test_stage(spark):
    kinds, html = {"html": b"<!D".hex()}, bytearray(b"<!Doc")
    rows = [(1, 5, "html", html, "1,000.5"), (2, 6, "html", html, "3"), (3, 5, "pdf", html, "3"), (4, 5, "html", html, "0.00"), (5, 5, "html", html, None), (6, None, "html", html, "1"), (7, 5, "html", None, "1"), (8, 5, "html", html, "x"), (9, 2, "html", bytearray(b"PK"), "1")]
    out = jobs.staged(spark.createDataFrame(rows, "job_id long, declared_size long, declared_type string, body binary, amount string"), F.lit("2024-02-03").cast("date"), kinds)
    assert {r.job_id: r.outcome for r in out.collect()} == {1: "proposed", 2: "size_mismatch", 3: "type_mismatch", 4: "amount_denied", 5: "amount_denied", 6: "size_mismatch", 7: "size_mismatch", 8: "amount_denied", 9: "type_mismatch"}
    first = out.where("job_id = 1").first()
    assert (float(first.amount), str(first.transaction_date)) == (1000.5, "2024-02-03")


class Held:
    """Map or list state in memory that notes the rows of the largest answer."""

    most = 0

    def __init__(self):
        self.rows, self.map = [], {}

    def get(self):
        Held.most = max(Held.most, len(self.rows))
        return iter(self.rows)

    def put(self, rows):
        self.rows = rows

    def clear(self):
        self.rows = []

    def getValue(self, k):
        Held.most = max(Held.most, *[len(c) for c in self.map[k] if isinstance(c, list)])
        return self.map[k]

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]

    def iterator(self):
        return iter(list(self.map.items()))


class Handle:
    def __init__(self):
        self.timer = None

    def getListState(self, *_):
        return Held()

    getMapState = getListState

    def registerTimer(self, at):
        self.timer = at


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_rows_by_the_hour():
    """All rows of an organisation were in memory whenever it was called; now those of one hour, with the same outcome, over several watermarks and with jobs without an actor."""
    rng, caps = random.Random(8), jobs.Caps(per_actor=1, per_org=3, seconds=400)
    rows = [("a", None if k % 9 == 0 else k % 5, k // 2 * 2, "finish" if k % 2 else "submit", T0 + timedelta(seconds=30 * k + rng.randrange(300))) for k in range(4000)]
    until = max(r[4] for r in rows) - timedelta(seconds=600)
    types = T.StructType([T.StructField("ms", T.LongType()), T.StructField("turn", T.IntegerType()), T.StructField("job_id", T.LongType()), T.StructField("actor", T.LongType()), T.StructField("kind", T.StringType())])
    made = [(round(at.timestamp() * 1000), int(kind == "submit"), job, actor, kind) for _, actor, job, kind, at in rows]
    rng.shuffle(made)
    Held.most, desk, handle, out = 0, jobs.JobProcessor(caps, types), Handle(), []
    desk.init(handle)
    chunks = [pd.DataFrame(made[k : k + 500], columns=["ms", "turn", "job_id", "actor", "kind"]) for k in range(0, len(made), 500)]
    end, first = round(until.timestamp() * 1000), min(r[0] for r in made)
    out += desk.handleInputRows(("a",), iter(chunks), Clock(0))
    assert not out and handle.timer == first
    for mark in (first + 5_000_000, first + 5_000_001, (first + end) // 2, end):
        out += desk.handleExpiredTimer(("a",), Clock(mark), None)
        assert handle.timer > mark
    assert sorted(("a", j, at, w) for pdf in out for _, j, at, w in pdf.itertuples(index=False)) == plain(rows, caps, 600)
    assert 0 < Held.most <= 200
