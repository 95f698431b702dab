"""Removal of repeated word windows with a log-structured fingerprint index.

The index has immutable runs, bucketed and sorted by fingerprint: for the hash of an anchor (see ``anchors``) how often it has been
met, and the least and greatest hash of the segments it stands for. A batch of documents becomes a run; it is merge-joined with the
runs before it, what meets is verified, and the runs are compacted into one when there are too many. Fingerprints met twice are
verified: where all their segments are one and the same, these are repeats as a whole; else each distinct segment is taken once
from its document, earlier batches included, and compared window by window: by 61 bits beside the 61 of the anchor.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Segments, batch_rows, bloom_has, bloom_of, covered, explode_windows, key_type, keyed
from .common import Prefix, cut, mix, partitions, shared_path, texts, word_hashes, words

MOST_OFTEN = 1000  # of n segments, no more than a thousand can each stand more than n / 1000 times
WORDS_AT_ONCE = 1 << 16  # words of a text whose windows are worked at one time


class FingerprintIndex:
    """Sorted immutable runs of (h, c, low, high), and the logs of the segments they came from: all files lie in the shared folder.

    ``runs``: names of the bucketed tables. ``logs``: the segments (key, at, n, h, x) of each batch.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, most_runs: int = 4):
        self.spark, self.buckets, self.most_runs = spark, buckets or partitions(spark), most_runs
        self.name, self.made, self.runs, self.logs = f"fingerprints_{uuid.uuid4().hex}", 0, [], []

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, "h").sortBy("h").format("parquet").option("path", shared_path(self.spark, table)).saveAsTable(table)
        return table

    def add(self, segments: DataFrame) -> DataFrame:
        """Add a batch (columns h and x at least, repeats included). Returns h, c, low and high over all runs, for fingerprints of the batch with c > 1."""
        run = self._write(segments.groupBy("h").agg(F.count("*").alias("c"), F.min("x").alias("low"), F.max("x").alias("high")))
        hits = self.spark.table(run)
        for old in self.runs:
            met = self.spark.table(old).select("h", F.col("c").alias("_c"), F.col("low").alias("_low"), F.col("high").alias("_high"))
            both = (F.col("c") + F.coalesce("_c", F.lit(0))).alias("c"), F.least("low", "_low").alias("low"), F.greatest("high", "_high").alias("high")
            hits = hits.join(met, "h", "left").select("h", *both)  # least and greatest skip nulls
        hits = cut(hits.where("c > 1"))
        self.runs.append(run)
        if len(self.runs) > self.most_runs:
            self.compact()
        return hits

    def compact(self) -> None:
        """One run in place of all."""
        if len(self.runs) < 2:
            return
        rows = reduce(DataFrame.unionByName, map(self.spark.table, self.runs))
        merged = self._write(rows.groupBy("h").agg(F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")))
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs = [merged]

    def drop(self) -> None:
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.runs, self.logs = [], []


def _segments(column: pa.Array, window: int, gram: int) -> Iterator[tuple[int, int, Segments, Prefix]]:
    """Number of the first document, its first word, segments and sums of the words' hashes; a long text comes in parts that share ``window`` - 1 words."""
    for run in texts(column, 1 << 18):
        begin, end, first = words(run)
        hashed = word_hashes(run.data, begin, end)
        if len(run) > 1:
            sums = Prefix(hashed)
            yield run.rows.start, 0, Segments(sums, first, window, gram), sums
            continue
        for base in range(0, max(len(hashed), 1), WORDS_AT_ONCE):
            part = hashed[base : base + WORDS_AT_ONCE + window - 1]
            sums = Prefix(part)
            yield run.rows.start, base, Segments(sums, np.array([0, len(part)]), window, gram), sums


def segment_log(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """key, at, n, h, x of every segment of ``rows`` (key, text), written to the shared folder."""

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for doc, base, s, sums in _segments(b.column(1), window, gram):
                yield from batch_rows(b.column(0), s.doc + doc, {"at": (s.at + base).astype(np.int32), "n": s.n.astype(np.int32), "h": s.h, "x": sums.of(s.start, s.start + s.n - 1 + window)})

    path = shared_path(rows.sparkSession, "segments")
    rows.mapInArrow(run, f"key {key_type(rows)}, at int, n int, h long, x long").write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _mark(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix(h * np.uint64(0x9E3779B97F4A7C15) ^ x)


def repeated_ranges(docs: DataFrame, window: int = 35, gram: int = 10, batches: int = 2, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """key, starts, ends: ranges of words of ``docs`` covered by windows that also start elsewhere, in ``docs`` or in ``history``.

    ``docs`` goes into the index in ``batches`` (all of them, by a hash of the id). An ``index`` that holds earlier documents says
    which windows of ``docs`` may have been met before; ``history`` (the earlier documents, same columns) gives the words that
    verify it. Only segments that meet a new one are read from it, and nothing is taken from its documents.
    """
    spark = docs.sparkSession
    rows, own, index = keyed(docs, id_col, text_col), index is None, index or FingerprintIndex(spark)
    if index.logs and history is None:
        raise ValueError("an index that holds earlier documents needs them as history")
    old_logs, new_logs, hits = list(index.logs), [], []
    for k in range(batches):
        log = segment_log(rows.where(F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(batches)) == k), window, gram)
        new_logs.append(log)
        hits.append(index.add(log))
    index.logs += new_logs
    # A later batch has seen more of a fingerprint than an earlier one.
    met = cut(reduce(DataFrame.unionByName, hits).groupBy("h").agg(F.max("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")))
    if own:
        index.drop()
    mixed = F.col("low") != F.col("high")
    bloom, bloom_mixed = (spark.sparkContext.broadcast(bloom_of(m, F.col("h"))) for m in (met, met.where(mixed)))

    def found_in(logs: list[DataFrame], new: bool) -> DataFrame:
        log, bits = reduce(DataFrame.unionByName, logs), bloom if new else bloom_mixed

        def maybe(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in some:
                yield b.filter(pa.array(bloom_has(bits.value, np.asarray(b.column(3), np.int64))))

        part = log.mapInArrow(maybe, log.schema)
        return part.join(met.select("h", mixed.alias("mixed")), "h").select("key", "at", "n", "h", "x", "mixed", F.lit(new).alias("new"))

    path = shared_path(spark, "met-segments")
    found = found_in(new_logs, True)
    if old_logs:
        found = found.unionByName(found_in(old_logs, False).where("mixed"))
    found.write.parquet(path)
    found = spark.read.parquet(path)
    whole = found.where("NOT mixed AND new").select("key", "at", "n")
    # Of mixed fingerprints, each distinct segment once.
    place = F.min(F.struct((~F.col("new")).alias("old"), "key", "at")).alias("first")
    kinds = cut(found.where("mixed").groupBy("h", "x").agg(F.count("*").alias("c"), place, F.first("n").alias("n")))
    # The thousand most frequent ones at most are met without a shuffle, so no task gets all copies of one.
    often = max(MOST_OFTEN, found.count() // MOST_OFTEN)
    hot, rest = F.broadcast(kinds.where(F.col("c") > often).select("h", "x")), kinds.where((F.col("c") > 1) & (F.col("c") <= often)).select("h", "x")
    repeated = found.where("mixed AND new")
    for part in (repeated.join(hot, ["h", "x"], "left_semi"), repeated.join(hot, ["h", "x"], "left_anti").join(rest, ["h", "x"], "left_semi")):
        whole = whole.unionByName(part.select("key", "at", "n"))

    def marks(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            h, x, t = (np.asarray(b.column(i), np.int64).view(np.uint64) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array((_mark(h, x) ^ t).view(np.int64))], names=["mark"])

    chosen = spark.sparkContext.broadcast(bloom_of(kinds.select("h", "x", F.xxhash64("first.key").alias("t")).mapInArrow(marks, "mark long"), F.col("mark")))

    def single(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of the chosen segments; what the filter lets through beside them are equal segments and ones that meet nothing."""
        for b in some:
            named = np.asarray(b.column(2), np.int64).view(np.uint64)
            for doc, _, s, sums in _segments(b.column(1), window, gram):
                x = sums.of(s.start, s.start + s.n - 1 + window)
                hit = np.flatnonzero(bloom_has(chosen.value, _mark(s.h, x) ^ named[s.doc + doc]))
                if not len(hit):
                    continue
                who, step = explode_windows(s.n[hit])
                start = s.start[hit][who] + step
                columns = {"h": s.h[hit][who], "x": x[hit][who], "off": step.astype(np.int16), "u": sums.of(start, start + window)}
                for first in range(0, len(who), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[first : first + 20_000].view(np.int64) if c.dtype == np.uint64 else c[first : first + 20_000]) for c in columns.values()], names=list(columns))

    sources = rows if not old_logs else rows.unionByName(keyed(history, id_col, text_col))
    path = shared_path(spark, "windows")
    sources.select("key", "text", F.xxhash64("key").alias("t")).mapInArrow(single, "h long, x long, off short, u long").write.parquet(path)
    each = spark.read.parquet(path)
    # One segment's windows differ from each other, so a window that repeats stands in segments of unlike hash.
    again = each.groupBy("h", "u").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low != high").select("h", "u")
    bad = each.join(again, ["h", "u"], "left_semi").groupBy("h", "x").agg(F.collect_set("off").alias("offs"))
    alone = kinds.where("c = 1 AND NOT first.old").select("h", "x", "first.key", "first.at")
    parts = bad.join(alone, ["h", "x"]).select("key", "at", F.explode("offs").alias("off")).select("key", (F.col("at") + F.col("off")).alias("a"), (F.col("at") + F.col("off") + window).alias("b"))
    ranges = whole.select("key", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + window).alias("b")).unionByName(parts)
    return ranges.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("r")).select("key", F.col("r.a").alias("starts"), F.col("r.b").alias("ends"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False, **how) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and ``kept`` with ``texts_out``.

    Null and empty texts have no words. Texts shorter than a window lose nothing, long ones are worked in parts. Every row is a
    document: rows that share an id, null ids among them, are told apart by their texts, and equal rows are copies of each other,
    so both lose what they share. Only the two named columns are read.
    """
    ranges = repeated_ranges(docs, window, id_col=id_col, text_col=text_col, **how)
    rows = keyed(docs, id_col, text_col).join(ranges, "key", "left").select(F.col("key.id").alias("id"), "text", "starts", "ends")
    kind = dict(docs.dtypes)[id_col]

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            starts, ends = b.column(2), b.column(3)
            for text in texts(b.column(1)):
                begin, end, first = words(text)
                out: dict[str, list] = {"n": [], "gone": [], "sha": [], "kept": []}
                data = text.data.tobytes()
                for k in range(len(text)):
                    lo, hi = first[k], first[k + 1]
                    keep = np.ones(hi - lo, bool)
                    row = text.rows.start + k
                    if starts[row].is_valid:
                        keep = ~covered(hi - lo, np.asarray(starts[row].values), np.asarray(ends[row].values))
                    kept = b" ".join([data[x:y] for x, y in zip(begin[lo:hi][keep].tolist(), end[lo:hi][keep].tolist())])
                    out["n"].append(hi - lo)
                    out["gone"].append(int(hi - lo - keep.sum()))
                    out["sha"].append(hashlib.sha256(kept).hexdigest())
                    if texts_out:
                        out["kept"].append(kept.decode())
                columns = [b.column(0).slice(text.rows.start, len(text)), pa.array(out["n"], pa.int64()), pa.array(out["gone"], pa.int64()), pa.array(out["sha"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out["kept"], pa.string())] * texts_out, names=[id_col, "n_words", "n_removed", "kept_sha256", *["kept"] * texts_out])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts_out)
