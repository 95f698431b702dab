"""Periodic run detection: words named by powers of two (Karp, Miller, Rosenberg), candidates from a grid, extended by name levels.

A level-k name stands for the 2**k words from a position on; two positions of one document have the same name exactly if these words are equal. Names come from
sorting pairs of names of the level below, so nothing is hashed and no suffix is sorted. Positions whose block stands nowhere else in its document get a
name of their own and leave the sort, and naming stops at the first level where all blocks differ: no common extension is longer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, words

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_AT_ONCE = 1 << 20  # grid points looked at together


@dataclass(frozen=True)
class Periods:
    """A run has ``times`` periods and ``least`` words at least. ``times`` is 3 or more: then each run's grid has a point followed by a whole period inside it."""

    least: int = 6
    times: int = 4

    def __post_init__(self):
        if self.times < 3 or self.least < 1:
            raise ValueError("times has to be 3 or more, least 1 or more")


def name_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The same number for the same word."""
    size = end - begin
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begin] = 1
    inside[end] -= 1
    packed = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    column = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and the ranks of these."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    last = np.ones(len(keys), bool)
    last[:-1] = new[1:]
    twice = ~(new & last)
    repeated, ranks = np.empty(len(keys), bool), np.empty(len(keys), np.int64)
    repeated[order], ranks[order] = twice, np.cumsum(new & twice) - 1
    return repeated, ranks


def name_levels(names: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Level by level the names of all positions and of the end; a block that is alone in its document, or crosses its end, has a negative name of its own."""
    n = len(names)
    alone = -1 - np.arange(n + 1, dtype=np.int64)
    levels = []
    where = np.arange(n)
    keys = doc * (int(names.max(initial=0)) + 1) + names
    while len(where):
        repeated, ranks = _repeated(keys)
        where, ranks = where[repeated], ranks[repeated]
        if not len(where):
            break
        level = alone.copy()
        level[where] = ranks
        levels.append(level)
        step = 1 << (len(levels) - 1)
        # Ranks are told apart by document, so that a pair of them is one block of one document.
        where = where[where + step < n]
        where = where[level[where + step] >= 0]
        where = where[doc[where] == doc[where + step]]
        keys = level[where] * (int(ranks.max()) + 1) + level[where + step]
    return levels


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from ``i`` on equal those from ``j`` on; with ``back``, how many before ``i`` equal those before ``j``. Not for i = j."""
    got = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, size = levels[k], 1 << k
        if back:
            a, b = i - got - size, j - got - size
            same = (a >= 0) & (level[a] == level[b])
        else:
            same = level[i + got] == level[j + got]
        got += same * size
    return got


def _grid(sizes: np.ndarray, firsts: np.ndarray, rules: Periods) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions and periods to look at: for a period q every (times - 2) * q-th position of the documents of times * q words or more.

    ``sizes`` falls from document to document. Equal words q apart stretch over (times - 1) * q positions in a run, so one point has q of them ahead of it.
    """
    longest = int(sizes[0]) // rules.times if len(sizes) else 0
    q = 1
    while q <= longest:
        most = min(longest, q + 4096)
        periods = np.arange(q, most + 1)
        enough = np.searchsorted(-sizes, -np.maximum(rules.times * periods, rules.least), "right")  # documents long enough for each
        upto = np.where(enough > 0, firsts[enough - 1] + sizes[enough - 1], 0)
        step = (rules.times - 2) * periods
        points = np.maximum(-(-(upto - periods) // step), 0)
        take = max(1, int(np.searchsorted(np.cumsum(points), _AT_ONCE, "right")))
        periods, step, points = periods[:take], step[:take], points[:take]
        total, before = int(points.sum()), np.cumsum(points) - points
        if total:
            which = np.repeat(np.arange(take), points)
            yield (np.arange(total) - before[which]) * step[which], periods[which]
        q += take


def runs_of(names: np.ndarray, sizes: np.ndarray, rules: Periods) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of documents that follow each other, longest first; starts and ends count through all of them."""
    firsts = np.cumsum(sizes) - sizes
    levels = name_levels(names, np.repeat(np.arange(len(sizes)), sizes))
    found = [np.zeros((0, 3), np.int64)]
    for i, q in _grid(sizes, firsts, rules) if levels else ():
        k = np.minimum(np.frexp(q)[1] - 1, len(levels) - 1)  # q words ahead are equal, so these 2**k are
        keep = np.zeros(len(i), bool)
        for level in np.unique(k):
            some = np.flatnonzero(k == level)
            keep[some] = levels[level][i[some]] == levels[level][i[some] + q[some]]
        i, q = i[keep], q[keep]
        start, end = i - extend(levels, i, i + q, back=True), i + q + extend(levels, i, i + q)
        good = end - start >= np.maximum(rules.times * q, rules.least)
        found.append(np.stack([start, end, q], 1)[good])
    rows = np.concatenate(found)
    # A stretch found by several periods has their least: the others are its multiples.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    start, end, q = rows[first].T
    return start, end, q


def find_runs(docs: DataFrame, rules: Periods = Periods(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed`` of each row.

    A run is a stretch of words of smallest period q that is as long as ``rules`` ask and that no neighbour extends with that period. ``collapsed`` has the words,
    joined by one space, that no run holds after its first period. One row for each input row, repeated ids included; a null or wordless text has no
    runs and an empty ``collapsed``. Nothing is shuffled; a task holds the names of a run of texts of 2 MB together, or of one longer text (eight bytes a word and level).
    """
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_words long, runs {RUN}, collapsed string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in texts(batch.column(1)):
                begin, end, first = words(run)
                sizes = np.diff(first)
                order = np.argsort(-sizes, kind="stable")
                # The words of all texts, longest text first.
                moved = np.cumsum(sizes[order]) - sizes[order]
                place = np.repeat(first[:-1][order] - moved, sizes[order]) + np.arange(len(begin))
                start, stop, q = runs_of(name_words(run.data, begin, end)[place], sizes[order], rules)
                doc = np.searchsorted(moved, start, "right") - 1
                # Texts without words come last and share the end as their first place: no run starts there.
                back = place[start] if len(start) else start
                shift = back - start
                gone = np.zeros(len(begin) + 1, np.int64)
                np.add.at(gone, start + shift + q, 1)
                np.add.at(gone, stop + shift, -1)
                kept = np.cumsum(gone[:-1]) == 0
                by = np.lexsort((q, back))
                back, length, q, doc = back[by], (stop - start)[by], q[by], order[doc][by] if len(doc) else doc
                cut = np.searchsorted(doc, np.arange(len(sizes) + 1))
                body = pa.StructArray.from_arrays([pa.array(back - first[doc]), pa.array(length), pa.array(q)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), body).cast(_RUN_ARROW)
                raw = run.data.tobytes()
                collapsed = []
                for k, (a, b) in enumerate(zip(first[:-1], first[1:])):
                    if cut[k] == cut[k + 1]:
                        left = raw[run.starts[k] : run.starts[k + 1]].split()  # bytes.split() parts words where words() does
                    else:
                        left = [raw[begin[w] : end[w]] for w in (np.flatnonzero(kept[a:b]) + a).tolist()]
                    collapsed.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays([batch.column(0)[run.rows], pa.array(sizes, pa.int64()), runs, pa.array(collapsed, pa.string())], names=[id_col, "n_words", "runs", "collapsed"])

    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def with_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``text_col``; in one document of ten, by the CRC-32 of its id, all words from one on repeat a few of them.

    Only built-in functions. With h the CRC and g = h // 10, word i >= a becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8). A null id has no CRC: its text stays.
    """
    space = r"[ \t\n\x0B\f\r]+"
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    # Decided before the text is split, so that nine texts of ten are not.
    hit = (h % 10 == 0) & F.coalesce(F.regexp_like(text_col, F.lit(r"[^ \t\n\x0B\f\r]")), F.lit(False))
    words_of = F.when(hit, F.filter(F.split(F.col(text_col), space), lambda w: w != ""))
    out = docs.select(F.col(id_col), F.col(text_col), words_of.alias("_words"), F.floor(h / 10).alias("_g"))
    out = out.withColumn("_n", F.size("_words")).withColumn("_a", F.expr("CAST(_g % _n AS INT)")).withColumn("_p", F.expr("CAST(1 + (_n - _a) div (3 + _g % 8) AS INT)"))
    tail = "slice(flatten(array_repeat(slice(_words, _a + 1, _p), CAST((_n - _a + _p - 1) div _p AS INT))), 1, _n - _a)"
    changed = F.expr(f"array_join(concat(slice(_words, 1, _a), {tail}), ' ')")
    return out.select(id_col, F.when(F.col("_words").isNotNull(), changed).otherwise(F.col(text_col)).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of digests for each row of ``find_runs``: the number of runs, the one of the greatest length / period, and SHA-256 of all runs and of what is left.

    The greatest ratio is found exactly: whole periods first, then what is left over as a fraction of the period (told apart by doubles for periods below 2**26). Ties: smallest start, then period.
    """
    rank = F.transform("runs", lambda r: F.struct((-F.floor(r["length"] / r["period"])).alias("w"), (-(r["length"] % r["period"]) / r["period"]).alias("f"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    best = F.array_min(rank)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    out = found.withColumn("_best", best).withColumn("_lines", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""))
    return out.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2("_lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
