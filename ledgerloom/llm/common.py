"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPACE = " \t\n\x0b\f\r"  # what separates words: [\x20\x09-\x0D]

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(WORD_SPACE.encode())] = True


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; where that is unset, a local one for a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "ledgerloom-checkpoints")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a reliable checkpoint: computed once, and read again after a lost executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(docs: DataFrame, id_col: str) -> DataFrame:
    """``docs`` as two columns, ``_row`` (a struct of all) and ``_key`` (the id): no name in ``docs`` can clash with a name used in a join."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_key"))


class Texts:
    """A run of documents as one byte buffer: document i is ``data[starts[i]:starts[i + 1]]``."""

    __slots__ = ("rows", "data", "starts")

    def __init__(self, rows: slice, data: np.ndarray, starts: np.ndarray):
        self.rows, self.data, self.starts = rows, data, starts

    def __len__(self) -> int:
        return len(self.starts) - 1


def texts(column: pa.Array, most: int = 2 << 20) -> Iterator[Texts]:
    """``column`` (strings or binary; null counts as empty) in runs of about ``most`` bytes; a longer text is a run of its own, never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if pa.types.is_large_binary(column.type) else column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Texts(slice(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(run: Texts, is_space: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of ``run``, and for each document the number of the first word (with the total last)."""
    inside = ~is_space[run.data]
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[run.starts] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[edge] = False
    after = np.zeros(n, bool)
    if n:
        after[:-1] = inside[1:]
        ends_at = run.starts[1:] - 1
        after[ends_at[(ends_at >= 0) & (np.diff(run.starts) > 0)]] = False
    begin = np.flatnonzero(inside & ~before[:n])
    end = np.flatnonzero(inside & ~after) + 1
    return begin, end, np.searchsorted(begin, run.starts)


_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


PRIME = np.uint64((1 << 61) - 1)
_61, _31, _30 = np.uint64(61), np.uint64(31), np.uint64(30)
_LOW31, _LOW30, _LOW32, _LOW29 = (np.uint64((1 << b) - 1) for b in (31, 30, 32, 29))
BASES = (0x0B3A1D5C9E8F2471, 0x15D27F0A6C3B9E85)  # below the prime


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime."""
    x = (x & PRIME) + (x >> _61)
    return np.where(x >= PRIME, x - PRIME, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 31 and 30 bits."""
    xh, xl, yh, yl = x >> _31, x & _LOW31, y >> _31, y & _LOW31
    middle = xh * yl + xl * yh
    return reduced(((xh * yh) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + xl * yl)


class Powers:
    """Powers of a base and of its inverse modulo the prime, made longer when needed."""

    def __init__(self, base: int):
        self.bases = (base, pow(base, -1, int(PRIME)))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            tables = []
            for b in self.bases:
                a = np.ones(1, np.uint64)
                while len(a) < n:
                    a = np.concatenate([a, times(a, np.full(1, pow(b, len(a), int(PRIME)), np.uint64))])
                tables.append(a)
            self.up, self.down = tables
        return self.up, self.down


_POWERS = [Powers(b) for b in BASES]


class Prefix:
    """Hashes of any slices of a sequence of 64-bit values, from one running sum: polynomials modulo 2**61 - 1."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        up, self.down = _POWERS[which].upto(n + 1)
        terms = times(reduced(values), up[:n])
        high, low = np.cumsum(terms >> np.uint64(32)), np.cumsum(terms & _LOW32)
        self.sums = np.zeros(n + 1, np.uint64)
        self.sums[1:] = reduced(((high & _LOW29) << np.uint64(32)) + (high >> np.uint64(29)) + low)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        part = times(reduced(self.sums[end] + PRIME - self.sums[begin]), self.down[begin])
        return mix(part + ((end - begin).astype(np.uint64) << _61))


    def grams(self, width: int) -> np.ndarray:
        """Hashes of all slices of ``width`` values."""
        part = times(reduced(self.sums[width:] + PRIME - self.sums[:-width]), self.down[: len(self.sums) - width])
        return mix(part + (np.uint64(width) << _61))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each word: words up to eight bytes are told apart exactly within their length, longer ones are chained by ``mix`` or, above 64 bytes, by XXH3."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - begin

    def part(some: np.ndarray | slice, k: int) -> np.ndarray:
        left = np.minimum(size[some] - 8 * k, 8).astype(np.uint64)
        return eight[begin[some] + 8 * k] & (np.uint64(_MASK) >> (np.uint64(64) - np.uint64(8) * left))

    out = mix(part(slice(None), 0) + size.astype(np.uint64) * _ODD)
    for k in range(1, 8):
        some = np.flatnonzero(size > 8 * k)
        if not len(some):
            return out
        out[some] = mix((out[some] ^ part(some, k)) * _ODD + np.uint64(k))
    raw = data.tobytes() if (size > 64).any() else b""
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[begin[i] : end[i]])
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out
