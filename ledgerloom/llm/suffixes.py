"""Removal of repeated byte strings with suffix arrays.

Windows of ``window`` bytes are gathered by their anchors (see ``anchors``), so that all windows that may be equal meet in one
block; segments equal as a whole collapse to their earliest place before that. Where one anchor has more distinct segments than a
block can hold, they are cut in halves by the anchor's distance from the window's start and gathered by the bytes that all windows
of a half have, again and again, until a group fits or its windows are all one. A block's segments are sorted into a suffix
array, and a breadth-first expansion of intervals by backward extension on its Burrows-Wheeler transform sets common-prefix
lengths in increasing order. It stops at ``window``: neighbours whose common prefix has not been set by then share a window.
In each run of such neighbours every window but the earliest is a repeat.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .anchors import Rolling, Segments, batch_rows, bloom_has, bloom_of, covered, key_type, keyed
from .common import cut, mix, shared_path, texts

AT_ONCE = 1 << 15  # bytes of text whose windows are worked at one time
BLOCK = 1 << 19  # bytes of segments in one suffix array, on average
GROUP = 1 << 20  # bytes of distinct segments of one anchor up to which they go to one block as they are; larger groups are split first
SEPARATOR = 256


def suffix_array(symbols: np.ndarray, length: int) -> np.ndarray:
    """Places of ``symbols`` (0 .. 256) in the order of the ``length`` or more symbols that follow."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for d in range(7):  # seven symbols of nine bits
        part = np.zeros(n, np.int64)
        part[: max(n - d, 0)] = symbols[d:] + 1
        key = (key << 9) | part
    done = 7
    while True:
        order = np.argsort(key)  # the order of equal keys does not matter
        new = np.ones(n, bool)
        ordered = key[order]
        new[1:] = ordered[1:] != ordered[:-1]
        if done >= length or new.all():
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        key = rank * (n + 1)
        key[: max(n - done, 0)] += rank[done:]
        done *= 2


def common_prefix_at_least(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in ``order`` but the first: whether its suffix shares ``length`` symbols with the one before.

    Level by level, an interval of suffixes that begin with a string w is extended to those of cw for every symbol c before it.
    The end of a new interval is a border at which the common prefix is as long as w, unless an earlier level has set it.
    """
    n = len(symbols)
    before = symbols[order - 1]  # the transform; the text is taken as a ring, which ends in a separator
    by_symbol = np.argsort(before.astype(np.int16), kind="stable")
    step = np.empty(n, np.int64)
    step[by_symbol] = np.arange(n)
    after, prior = np.full(n, n), np.full(n, -1)
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    prior[by_symbol[1:][same]] = by_symbol[:-1][same]
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    low, high = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(length):
        if not len(low):
            break
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner]
        key = owner * 512 + before[place]
        last = after[place] >= high[owner]
        first = prior[place] < low[owner]
        a, b = np.argsort(key[first]), np.argsort(key[last])
        starts, ends = step[place[first][a]], step[place[last][b]] + 1
        new = unset[ends]
        unset[ends[new]] = False
        low, high = starts[new], ends[new]
    return unset[:n]


def repeats_in_block(segments: list[bytes], doc: np.ndarray, at: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of the segments equal an earlier one: numbers of segments, and windows from the segment's start."""
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.full(int((sizes + 1).sum()), SEPARATOR, np.int64)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    inside = np.arange(len(symbols)) - begin[owner]
    symbols[inside < sizes[owner]] = np.frombuffer(b"".join(segments), np.uint8)
    order = suffix_array(symbols, window)
    near = common_prefix_at_least(symbols, order, window)
    group = np.cumsum(~near)
    valid = inside[order] < n[owner[order]]
    order, group = order[valid], group[valid]
    who, off = owner[order], inside[order]
    rank = np.lexsort((at[who] + off, doc[who], group))
    later = np.zeros(len(rank), bool)
    later[1:] = group[rank][1:] == group[rank][:-1]
    return who[rank][later], off[rank][later]


def joined(who: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that follow each other in a segment: its number, and the first and last window."""
    order = np.lexsort((off, who))
    who, off = who[order], off[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(who)) - 1
    return (who[first], off[first], off[last]) if len(who) else (who, off, off)


def _segments(column: pa.Array, window: int, gram: int) -> Iterator[tuple[int, int, Segments, bytes]]:
    """Number of the first document, its first byte, segments and bytes; a long text comes in parts that share ``window`` - 1 bytes."""
    for run in texts(column, AT_ONCE):
        long = len(run) == 1 and len(run.data) > AT_ONCE
        for base in range(0, len(run.data), AT_ONCE) if long else (0,):
            data = run.data[base : base + AT_ONCE + window - 1] if long else run.data
            yield run.rows.start, base, Segments(Rolling(data), np.array([0, len(data)]) if long else run.starts, window, gram), data.tobytes()


def _names(bodies: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxh3_64_intdigest, bodies)), np.uint64)


def _bodies(s: Segments, hit: np.ndarray, raw: bytes, window: int) -> list[bytes]:
    return [raw[x:y] for x, y in zip(s.start[hit].tolist(), (s.start[hit] + s.n[hit] - 1 + window).tolist())]


def _mark(h: np.ndarray, at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One hash of an occurrence of a segment; ``key`` has hashes of keys."""
    return mix(h * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)) ^ key


def _longs(column: pa.Array) -> np.ndarray:
    return np.asarray(column, np.int64).view(np.uint64)


def _ordinal(keys: pa.StructArray) -> np.ndarray:
    """Numbers in the order of the keys, as Spark orders them: null ids first."""
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    ids = np.asarray(pa.compute.rank(keys.field("id"), null_placement="at_start", tiebreaker="dense"), np.int64)
    t = np.asarray(keys.field("t"), np.int64)
    order = np.lexsort((t, ids))
    new = np.zeros(len(order), np.int64)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (t[order][1:] != t[order][:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _halves(live: DataFrame, window: int) -> DataFrame:
    """Segments of crowded groups, each cut in two by the anchor's distance from a window's start: the halves of low .. high.

    All windows of a half contain the same piece around the anchor; its hash is the half's ``group``. Equal windows have equal
    distances and pieces, so they meet in one group of the next round.
    """

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            rows, columns = [], {c: [] for c in ("at", "n", "off", "low", "high", "group", "body")}
            fields = [b.column(i).to_pylist() for i in range(1, 7)]
            for i, (at, n, off, low, high, body) in enumerate(zip(*fields)):
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    first, last = max(off - hi, 0), min(off - lo, n - 1)  # windows from the segment's start
                    if lo > hi or first > last:
                        continue
                    rows.append(i)
                    group = xxh3_64_intdigest(body[off - lo : off + window - hi], seed=lo * 4096 + hi)
                    for c, v in zip(columns, (at + first, last - first + 1, off - first, lo, hi, group - (1 << 64) if group >> 63 else group, body[first : last + window])):
                        columns[c].append(v)
            kinds = dict(zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(v, kinds[c]) for c, v in columns.items()), pa.array(_names(columns["body"]).view(np.int64))], names=["key", *columns, "s"])

    schema = f"key {key_type(live)}, at int, n int, off int, low int, high int, group long, body binary, s long"
    return live.select("key", "at", "n", "off", "low", "high", "body").mapInArrow(run, schema)


def repeated_ranges(docs: DataFrame, window: int = 100, gram: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, starts, ends: ranges of bytes covered by windows that also start earlier (smaller key, or same document further up)."""
    spark, span = docs.sparkSession, F.col("n") - 1 + window
    rows = keyed(docs, id_col, text_col)
    kind = key_type(rows)

    def anchors(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for _, _, s, _ in _segments(b.column(0), window, gram):
                yield pa.RecordBatch.from_arrays([pa.array(s.h.view(np.int64))], names=["h"])

    met = cut(rows.select("text").mapInArrow(anchors, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    bloom = spark.sparkContext.broadcast(bloom_of(met, F.col("h")))

    def candidates(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            for doc, base, s, raw in _segments(b.column(1), window, gram):
                hit = np.flatnonzero(bloom_has(bloom.value, s.h))
                yield from batch_rows(b.column(0), s.doc[hit] + doc, {"at": (s.at[hit] + base).astype(np.int32), "n": s.n[hit].astype(np.int32), "h": s.h[hit], "s": _names(_bodies(s, hit, raw, window))})

    # Made from the texts twice rather than kept: that costs less than what it would take of the disk.
    found = rows.mapInArrow(candidates, f"key {kind}, at int, n int, h long, s long")
    # Copies of a segment (by 64 bits of XXH3 beside the anchor's) collapse to the earliest, before anything is brought together.
    firsts = found.groupBy("h", "s").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("c"), F.first("n").alias("n"))
    firsts = cut(firsts)
    again = found.join(firsts.where("c > 1").select("h", "s", "first"), ["h", "s"]).where("struct(key, at) != first")
    results = [again.select("key", F.col("at").alias("a"), (F.col("at") + span).alias("b"))]
    crowd = firsts.groupBy("h").agg(F.count("*").alias("k"), F.sum(span).alias("bytes")).where("k > 1")
    chosen = cut(firsts.join(crowd, "h").select("h", "first.key", "first.at", "n", (F.col("bytes") > GROUP).alias("large")))
    sizes = {r.large: (r.rows, r.bytes) for r in chosen.groupBy("large").agg(F.count("*").alias("rows"), F.sum(span).alias("bytes")).collect()}

    def bodies(large: bool) -> DataFrame:
        """The chosen segments with their bytes, each once: what the filter lets through beside them is dropped by a join."""
        some = chosen.where(F.col("large") == large)

        def marks(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in some:
                yield pa.RecordBatch.from_arrays([pa.array(_mark(_longs(b.column(0)), np.asarray(b.column(1), np.int64), _longs(b.column(2))).view(np.int64))], names=["mark"])

        wanted = spark.sparkContext.broadcast(bloom_of(some.select("h", "at", F.xxhash64("key").alias("t")).mapInArrow(marks, "mark long"), F.col("mark")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc, base, s, raw in _segments(b.column(1), window, gram):
                    hit = np.flatnonzero(bloom_has(wanted.value, _mark(s.h, s.at + base, _longs(b.column(2))[s.doc + doc])))
                    columns = {"at": (s.at[hit] + base).astype(np.int32), "n": s.n[hit].astype(np.int32), "off": s.off[hit].astype(np.int32), "h": s.h[hit]}
                    yield from batch_rows(b.column(0), s.doc[hit] + doc, columns | {"body": pa.array(_bodies(s, hit, raw, window), pa.binary())}, 5_000)

        body = rows.select("key", "text", F.xxhash64("key").alias("t")).mapInArrow(run, f"key {kind}, at int, n int, off int, h long, body binary")
        return body.join(some.select("h", "key", "at"), ["h", "key", "at"], "left_semi").dropDuplicates(["h", "key", "at"])

    columns, total = ["key", "at", "n", "group", "body"], sizes.get(False, (0, 0))[1]
    blocks, live = [bodies(False).withColumnRenamed("h", "group").select(*columns)], None
    if True in sizes:
        live = _written(bodies(True).select("key", "at", "n", "off", F.lit(0).alias("low"), F.lit(window - gram).alias("high"), "body"), "crowds")
    # Groups too large for a block: each round halves the distances, until a group's windows are all one.
    while live is not None:
        parts = _written(_halves(live, window), "halves")
        heads = cut(parts.groupBy("group", "s").agg(F.min(F.struct("key", "at")).alias("first"), F.count("*").alias("c"), F.first("n").alias("n")))
        later = parts.join(heads.where("c > 1").select("group", "s", "first"), ["group", "s"]).where("struct(key, at) != first")
        results.append(later.select("key", F.col("at").alias("a"), (F.col("at") + span).alias("b")))
        size = heads.groupBy("group").agg(F.count("*").alias("k"), F.sum(span).alias("bytes")).where("k > 1")
        left = parts.join(heads.join(size, "group").select("group", "s", "first.key", "first.at", "bytes"), ["group", "s", "key", "at"])
        left = _written(left.dropDuplicates(["group", "s", "key", "at"]), "left")
        fits = left.where(F.col("bytes") <= GROUP).select(*columns)
        blocks.append(fits)
        total += fits.agg(F.sum(F.length("body"))).first()[0] or 0
        live = left.where(F.col("bytes") > GROUP).select("key", "at", "n", "off", "low", "high", "body")
        live = None if live.isEmpty() else live
    body = reduce(DataFrame.unionByName, blocks)
    n_blocks = max(1, math.ceil(total / BLOCK))

    def solve(table: pa.Table) -> pa.Table:
        n, keys, at = np.asarray(table.column("n"), np.int64), table.column("key"), np.asarray(table.column("at"), np.int64)
        who, off = repeats_in_block(table.column("body").to_pylist(), _ordinal(keys), at, n, window)
        who, first, last = joined(who, off)
        return pa.table([keys.take(pa.array(who)), pa.array((at[who] + first).astype(np.int32)), pa.array((at[who] + last + window).astype(np.int32))], names=["key", "a", "b"])

    block = F.pmod(F.xxhash64("group"), F.lit(n_blocks)).alias("block")
    results.append(body.select(block, "key", "at", "n", "body").groupBy("block").applyInArrow(solve, f"key {kind}, a int, b int"))
    ranges = reduce(DataFrame.unionByName, results).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("r"))
    return ranges.select("key", F.col("r.a").alias("starts"), F.col("r.b").alias("ends"))


def remove_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", texts_out: bool = False, gram: int = 20) -> DataFrame:
    """One row for each input row: id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary) with ``texts_out``.

    A null text counts as empty; long texts are worked in parts. Rows of one id and unlike texts are documents of their own, in the
    order of a hash of their texts; null ids come before all others. Rows equal in id and text are one document read twice: they
    share their result. Only the two named columns are read.
    """
    ranges = repeated_ranges(docs, window, gram, id_col, text_col)
    kind = dict(docs.dtypes)[id_col]
    rows = keyed(docs, id_col, text_col).join(ranges, "key", "left").select(F.col("key.id").alias("id"), "text", "starts", "ends")

    def run(some: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some:
            starts, ends = b.column(2), b.column(3)
            for text in texts(b.column(1)):
                out: dict[str, list] = {"n": [], "gone": [], "spans": [], "sha": [], "kept": []}
                for k in range(len(text)):
                    data = text.data[text.starts[k] : text.starts[k + 1]]
                    row, bad = text.rows.start + k, np.zeros(len(data), bool)
                    if starts[row].is_valid:
                        bad = covered(len(data), np.asarray(starts[row].values), np.asarray(ends[row].values))
                    kept = data[~bad].tobytes()
                    out["n"].append(len(data))
                    out["gone"].append(int(bad.sum()))
                    out["spans"].append(int((bad[1:] & ~bad[:-1]).sum()) + int(bad[:1].sum()))
                    out["sha"].append(hashlib.sha256(kept).hexdigest())
                    if texts_out:
                        out["kept"].append(kept)
                columns = [b.column(0).slice(text.rows.start, len(text)), *(pa.array(out[c], pa.int64()) for c in ("n", "gone", "spans")), pa.array(out["sha"], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(out["kept"], pa.binary())] * texts_out, names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts_out])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts_out)
