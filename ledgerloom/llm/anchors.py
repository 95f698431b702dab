"""Anchors: a sparse set of places such that equal windows of a text have equal anchors.

The anchor of a window of ``window`` units is, of its grams of ``gram`` units, the leftmost one of least hash. Equal windows
have equal anchors at equal distances, so windows need to be compared only if the hashes of their anchors are equal. Windows
that follow each other and share an anchor form a segment; about one unit in (window - gram) / 2 starts one. Unequal grams of
equal hash only bring more windows together: what is equal is decided by what meets at an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

BLOOM_BITS = 27  # a filter has 2 ** 27 bits (16 MB) at every size of input; what it lets through is joined exactly afterwards
_PLACE = np.uint64((1 << 28) - 1)


class Slices(Protocol):
    """Hashes of all slices of one width of a sequence."""

    def grams(self, width: int) -> np.ndarray: ...


_BYTE = np.random.default_rng(0x5EED).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Quick hashes of slices of bytes (polynomials modulo 2**64): to choose anchors by, not to decide what is equal."""

    up = down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(Rolling.up) < n:
            for name, b in (("up", _BASE), ("down", _INVERSE)):
                a = np.full(max(n, 1 << 17), b, np.uint64)
                a[0] = 1
                setattr(Rolling, name, np.multiply.accumulate(a))
        self.sums = np.zeros(n, np.uint64)
        terms = _BYTE[data]
        terms *= Rolling.up[: n - 1]
        np.cumsum(terms, out=self.sums[1:])

    def grams(self, width: int) -> np.ndarray:
        out = self.sums[width:] - self.sums[:-width]
        out *= Rolling.down[: len(out)]
        return out


class Segments:
    """Segments of a run of documents: ``doc`` (number in the run), ``at`` (first window, from the document's start), ``n`` (windows), ``h`` (the anchor's hash), ``off`` (the anchor's place, from the segment's start) and ``start`` (first window, from the run's start)."""

    __slots__ = ("doc", "at", "n", "h", "off", "start")

    def __init__(self, sums: Slices, first: np.ndarray, window: int, gram: int):
        total = int(first[-1])
        w, places = window - gram + 1, total - window + 1
        if places < 1:
            for name in self.__slots__:
                setattr(self, name, np.zeros(0, np.uint64 if name == "h" else np.int64))
            return
        value = sums.grams(gram)
        low = (value & ~_PLACE) | np.arange(len(value), dtype=np.uint64)  # ties go to the left
        span = 1
        while span * 2 <= w:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < w:
            low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
        low &= _PLACE
        new = np.ones(places, bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        new[first[first < places]] = True
        past = first[1:] - window + 1  # the first windows that would reach into the next document
        new[past[(past >= 0) & (past < places)]] = True
        start = np.flatnonzero(new)
        n = np.diff(np.append(start, places))
        doc = np.searchsorted(first, start, "right") - 1
        inside = start + window <= first[doc + 1]
        self.start, self.n, self.doc = start[inside], n[inside], doc[inside]
        self.at = self.start - first[self.doc]
        anchor = low[self.start].astype(np.int64)
        self.h, self.off = value[anchor], anchor - self.start


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key`` (struct of id and a hash of the text, which tells rows of one id apart and makes null ids comparable) and ``text``."""
    text = F.col(text_col)
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("t")).alias("key"), text.alias("text"))


def key_type(rows: DataFrame) -> str:
    return dict(rows.dtypes)["key"]


def explode_windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For segments of ``n`` windows: the number of each window's segment, and the window's place in it."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _bits(keys: np.ndarray) -> Iterator[np.ndarray]:
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        yield mix(keys.view(np.uint64) * np.uint64(odd)) >> np.uint64(64 - BLOOM_BITS)


def bloom_of(keys: DataFrame, column: Column) -> np.ndarray:
    """The filter's 32-bit words for the longs in ``column``; the driver gets one row per word that has a bit (4 M at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.concatenate(list(_bits(np.asarray(b.column(0), np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(5)).astype(np.int32)), pa.array((np.uint64(1) << (bit & np.uint64(31))).astype(np.int64))], names=["word", "set"])

    words = keys.select(column.alias("k")).mapInArrow(run, "word int, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    out = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    out[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("set"), np.int64).astype(np.uint32)
    return out


def bloom_has(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    out = np.ones(len(keys), bool)
    for bit in _bits(keys):
        out &= (bloom[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return out


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the places in any of the ranges."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, np.minimum(starts, size), 1)
    np.add.at(edge, np.minimum(ends, size), -1)
    return np.cumsum(edge[:size]) > 0


def batch_rows(keys: pa.Array, doc: np.ndarray, columns: dict[str, np.ndarray | pa.Array], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of ``key`` and ``columns`` (unsigned longs as longs)."""
    for first in range(0, len(doc), most):
        cut = slice(first, first + most)
        arrays = [keys.take(pa.array(doc[cut]))]
        for v in columns.values():
            arrays.append(v[cut] if isinstance(v, pa.Array) else pa.array(v[cut].view(np.int64) if v.dtype == np.uint64 else v[cut]))
        yield pa.RecordBatch.from_arrays(arrays, names=["key", *columns])
