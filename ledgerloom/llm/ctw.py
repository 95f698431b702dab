"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, each with a tree of contexts: the nearest ``DEPTH`` bytes, nearest first. A node has the
Krichevsky-Trofimov estimate of its counts; its weighted probability is half its own estimate and half the product of its
children's. The model is the mixture that this gives over all depths after the training documents; a context that training has
never shown ends the mixture at its longest known part. Texts are lower-cased (A-Z) and end in one byte that no UTF-8 has, so
the scores are probabilities of whole texts.

Tasks send each distinct n-gram once with its count; counts are summed per n-gram over the corpus. Subtrees below ``SPLIT`` bytes
are worked in buckets, the few levels above by grouping. For scoring, documents are dealt to blocks; a block's distinct keys fetch
their values by a join, so nothing that grows with the corpus is broadcast or passes through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, cut, lower_ascii, partitions, texts, word_hashes, words

DEPTH, SPLIT = 5, 3
END = 0xFF  # the byte before and after a text
BLOCK = 40 << 20  # bytes of text of a block
BUCKET = 1 << 20  # n-grams of a bucket of contexts, on average
WORD = np.uint64(1 << 63)  # keys with this bit are words, the others n-grams
END_WORD = np.uint64((1 << 64) - 1)
HELD = 2  # the remainder of a held-out document


def grams(run: Texts, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context bytes from the nearest on, then the byte) of every byte and end, and each document's first place."""
    n = len(run)
    sizes = np.diff(run.starts)
    buffer = np.full(len(data) + n * (DEPTH + 1), END, np.uint8)
    doc = np.repeat(np.arange(n), sizes)
    buffer[np.arange(len(data)) + doc * (DEPTH + 1) + DEPTH] = data
    wide = buffer.astype(np.uint64)
    key = wide[DEPTH:].copy()  # the byte itself
    for d in range(1, DEPTH + 1):
        key |= wide[DEPTH - d : len(wide) - d] << np.uint64(8 * (DEPTH + 1 - d))
    starts = run.starts[:-1] + np.arange(n) * (DEPTH + 1)
    inside = np.ones(len(key), bool)
    for d in range(1, DEPTH + 1):  # what lies between two documents
        at = starts[1:] - d
        inside[at] = False
    return key[inside], run.starts[:-1] + np.arange(n)


def word_keys(run: Texts, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of every word and of every document's end, and each document's first place."""
    begin, end, first = words(Texts(run.rows, data, run.starts))
    hashed = word_hashes(data, begin, end) | WORD
    hashed[hashed == END_WORD] -= np.uint64(1)
    n = len(run)
    return np.insert(hashed, first[1:], END_WORD), first[:-1] + np.arange(n)


def _sorted_counts(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weight is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(weight, at) if len(at) else weight


class _Counts:
    """Distinct keys and counts of a task, merged whenever the parts have grown."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 1_500_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            keys = np.concatenate([k for k, _ in self.parts]) if self.parts else np.zeros(0, np.uint64)
            counts = np.concatenate([c for _, c in self.parts]) if self.parts else np.zeros(0, np.int64)
            self.parts = [_sorted_counts(keys, counts)]
        self.size = len(self.parts[0][0]) // 2
        return self.parts[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, train) to (key, training count) of each distinct key; 0 for keys of held-out texts only."""
    kept = _Counts()

    def out() -> Iterator[pa.RecordBatch]:
        keys, counts = kept.merge()
        for first in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[first : first + 100_000].view(np.int64)), pa.array(counts[first : first + 100_000])], names=["key", "n"])

    for batch in batches:
        train = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        for wanted in (True, False):
            some = batch.column(0).filter(pa.array(train == wanted))
            for run in texts(some):
                data = lower_ascii(run.data)
                for of in (grams, word_keys):
                    keys, n = _sorted_counts(of(run, data)[0])
                    kept.add(keys, n if wanted else np.zeros_like(n))
        if kept.size > 6_000_000:
            yield from out()
            kept = _Counts()
    yield from out()


_SMALL = np.array([math.lgamma(k / 2) if k else 0.0 for k in range(4096)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Of whole and half numbers above 0: looked up where small, else by Stirling's series."""
    small = x < 2000
    y = np.where(small, 2000.0, x)
    big = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return np.where(small, _SMALL[np.where(small, 2 * x, 1).astype(np.int64)], big)


def estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


_HALF = math.log(0.5)


def _weigh(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability, and the weight of the node's own estimate; ``below``: the sum of its children's, None at the last depth."""
    own = estimate(n0, n1)
    if below is None:
        return own, np.ones_like(own)
    both = np.logaddexp(own + _HALF, below + _HALF)
    return both, np.exp(own + _HALF - both)


class _Level:
    __slots__ = ("node", "n0", "n1", "log", "beta", "parent")


def subtrees(key: np.ndarray, n: np.ndarray, j: int) -> list[_Level]:
    """Levels DEPTH .. SPLIT of the trees of decision ``j`` over sorted n-grams; nodes are context << j | bits so far."""
    symbol = key & np.uint64(255)
    node = (key >> np.uint64(8) << np.uint64(j)) | (symbol >> np.uint64(8 - j))
    bit = (symbol >> np.uint64(7 - j)) & np.uint64(1) == 1
    out: list[_Level] = []
    n1, n0, below = np.where(bit, n, 0).astype(np.float64), np.where(bit, 0, n).astype(np.float64), None
    for depth in range(DEPTH, SPLIT - 1, -1):
        level = _Level()
        level.node, back = np.unique(node, return_inverse=True)
        level.n0, level.n1 = np.bincount(back, n0, len(level.node)), np.bincount(back, n1, len(level.node))
        if depth < DEPTH:
            below = np.bincount(back, out[-1].log, len(level.node))
        level.log, level.beta = _weigh(level.n0, level.n1, below)
        level.parent = back  # of what is one level down; of the n-grams at the last depth
        out.append(level)
        bits = level.node & np.uint64((1 << j) - 1)
        node = (level.node >> np.uint64(j + 8) << np.uint64(j)) | bits
        n0, n1 = level.n0, level.n1
    return out


def _heap(node: np.ndarray, j: int) -> np.ndarray:
    """context << 8 | place of the decision in the byte's tree (1 to 255)."""
    bits = node & np.uint64((1 << j) - 1)
    return (node >> np.uint64(j) << np.uint64(8)) | bits | np.uint64(1 << j)


def _up(table: pa.Table) -> pa.Table:
    key, n = _bucket_of(table)
    node, n0, n1, log, beta = [], [], [], [], []
    for j in range(8):
        top = subtrees(key, n, j)[-1]
        for to, v in ((node, _heap(top.node, j)), (n0, top.n0), (n1, top.n1), (log, top.log), (beta, top.beta)):
            to.append(v)
    parts = [np.concatenate(x) for x in (node, n0, n1, log, beta)]
    return pa.table([pa.array(parts[0].view(np.int64)), *map(pa.array, parts[1:])], names=["node", "n0", "n1", "log", "beta"])


def _bucket_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key = np.asarray(table.column("key"), np.int64).view(np.uint64)
    order = np.argsort(key)
    return key[order], np.asarray(table.column("n"), np.float64)[order]


def _down(table: pa.Table, upper: pa.Table) -> pa.Table:
    key, n = _bucket_of(table)
    known = np.asarray(upper.column("node"), np.int64).view(np.uint64)
    order = np.argsort(known)
    known, mass, left, live = known[order], *(np.asarray(upper.column(c))[order] for c in ("mass", "left", "live"))
    total = np.zeros(len(key))
    symbol = key & np.uint64(255)
    for j in range(8):
        levels = subtrees(key, n, j)
        top = levels[-1]
        at = np.searchsorted(known, _heap(top.node, j))
        a, w, on = mass[at], left[at], live[at].astype(bool)
        for i in range(len(levels) - 1, 0, -1):
            level, child = levels[i], levels[i - 1]
            p = (level.n1 + 0.5) / (level.n0 + level.n1 + 1)
            up = level.parent
            seen = on[up] & (child.n0 + child.n1 > 0)
            stop = on[up] & ~seen
            a, w = np.where(seen, a[up] + w[up] * level.beta[up] * p[up], np.where(stop, a[up] + w[up] * p[up], a[up])), np.where(seen, w[up] * (1 - level.beta[up]), 0.0)
            on = seen
        last = levels[0]
        one = np.where(on, a + w * (last.n1 + 0.5) / (last.n0 + last.n1 + 1), a)[last.parent]
        bit = (symbol >> np.uint64(7 - j)) & np.uint64(1) == 1
        total += np.log10(np.clip(np.where(bit, one, 1 - one), 1e-12, 1.0))
    return pa.table([pa.array(key.view(np.int64)), pa.array(total)], names=["key", "value"])


def _merge_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        log, beta = _weigh(np.asarray(b.column(1)), np.asarray(b.column(2)), np.asarray(b.column(3)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(log), pa.array(beta)], names=["node", "n0", "n1", "log", "beta"])


def train(counts: DataFrame) -> DataFrame:
    """key and value (log10 probability of the byte after its context) of every n-gram in ``counts`` (key, n)."""
    spark = counts.sparkSession
    # Contexts of SPLIT bytes are dealt to buckets of about BUCKET n-grams; one context has 256 ** (DEPTH + 1 - SPLIT) at most.
    n_buckets = max(4 * partitions(spark), math.ceil(counts.where("key >= 0").count() / BUCKET))
    of_bucket = F.pmod(F.xxhash64(F.shiftright("key", 8 * (DEPTH + 1 - SPLIT))), F.lit(n_buckets))
    rows = counts.where("key >= 0").select(of_bucket.alias("bucket"), "key", "n")
    shape = "node long, n0 double, n1 double, log double, beta double"
    levels = [cut(rows.groupBy("bucket").applyInArrow(_up, shape))]
    parent = F.shiftleft(F.shiftright("node", 16), 8) + F.col("node").bitwiseAND(255)
    for _ in range(SPLIT):  # at most 256 ** d contexts of d bytes, 255 nodes each
        sums = levels[-1].groupBy(parent.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("below"))
        levels.append(cut(sums.mapInArrow(_merge_level, shape)))
    above = levels.pop().select("node", "n0", "n1", "beta", F.lit(0.0).alias("mass"), F.lit(1.0).alias("left"), F.lit(True).alias("live"))
    while levels:
        up = above.select(*[F.col(c).alias(f"u_{c}") for c in above.columns])
        own = levels.pop().withColumn("_p", parent)
        joined = own.join(up, F.col("_p") == F.col("u_node"))
        p = (F.col("u_n1") + 0.5) / (F.col("u_n0") + F.col("u_n1") + 1)
        seen = F.col("u_live") & (F.col("n0") + F.col("n1") > 0)
        mass = F.when(seen, F.col("u_mass") + F.col("u_left") * F.col("u_beta") * p).when(F.col("u_live"), F.col("u_mass") + F.col("u_left") * p).otherwise(F.col("u_mass"))
        above = joined.select("node", "n0", "n1", "beta", mass.alias("mass"), F.when(seen, F.col("u_left") * (1 - F.col("u_beta"))).otherwise(0.0).alias("left"), seen.alias("live"))
    context = F.pmod(F.xxhash64(F.shiftright("node", 8)), F.lit(n_buckets))
    top = above.select(context.alias("bucket"), "node", "mass", "left", "live")
    return rows.groupBy("bucket").cogroup(top.groupBy("bucket")).applyInArrow(_down, "key long, value double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10), bits_per_byte (the code length of the text and its end, per byte of these).

    Documents with crc32(id as text) mod 7 other than 2 train. A null text counts as empty: one token, its end. Without
    training documents every bit has probability one half. A null id counts as the empty text for the remainder.
    """
    spark = docs.sparkSession
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(7)) == HELD
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = rows.select("text", ~F.col("held")).mapInArrow(_count, "key long, n long")
    counts = cut(counted.groupBy("key").agg(F.sum("n").alias("n")))
    tokens = counts.where("key < 0").agg(F.sum("n"), F.count_if(F.col("n") > 0)).first()
    n_all, n_distinct = int(tokens[0] or 0), int(tokens[1] or 0)
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    n_blocks = max(1, math.ceil(size / BLOCK))
    block = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(n_blocks)).cast("int")
    dealt = rows.select(block.alias("block"), "id", "held", "text")
    values = train(counts).unionByName(counts.where("key < 0").select("key", F.log10(F.col("n") + 1.0).alias("value")))

    def distinct(table: pa.Table) -> pa.Table:
        kept = _Counts()
        for part in table.column("text").chunks:
            for run in texts(part):
                data = lower_ascii(run.data)
                for of in (grams, word_keys):
                    kept.add(*_sorted_counts(of(run, data)[0]))
        keys = kept.merge()[0]
        number = table.column("block")[0].as_py()
        return pa.table([pa.array(np.full(len(keys), number, np.int32)), pa.array(keys.view(np.int64))], names=["block", "key"])

    asked = dealt.groupBy("block").applyInArrow(distinct, "block int, key long")
    fetched = asked.join(values, "key").select("block", "key", "value")
    shift = math.log10(n_all + n_distinct + 1)

    def sums(table: pa.Table, found: pa.Table) -> pa.Table:
        index = pd.Index(np.asarray(found.column("key"), np.int64))
        value = np.asarray(found.column("value"), np.float64)
        out: dict[str, list] = {c: [] for c in ("n_tokens", "n_known", "base", "score", "bytes")}
        for part in table.column("text").chunks:
            for run in texts(part):
                data = lower_ascii(run.data)
                key, first = grams(run, data)
                out["score"].append(np.add.reduceat(value[index.get_indexer(key.view(np.int64))], first))
                out["bytes"].append(np.diff(np.append(first, len(key))))
                key, first = word_keys(run, data)
                got = value[index.get_indexer(key.view(np.int64))]
                size = np.diff(np.append(first, len(key)))
                out["n_tokens"].append(size)
                out["n_known"].append(np.add.reduceat((got > 0).astype(np.int64), first))
                out["base"].append(np.add.reduceat(got, first) - size * shift)
        join = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        n = table.num_rows
        return pa.table(
            [table.column("id"), table.column("held"), pa.array(join["n_tokens"].astype(np.int64)), pa.array(join["n_known"].astype(np.int64)), pa.array(np.full(n, n_all)), pa.array(join["base"]), pa.array(join["score"]), pa.array(-join["score"] * math.log2(10) / np.maximum(join["bytes"], 1))],
            names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
        )

    shape = f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(sums, shape)
