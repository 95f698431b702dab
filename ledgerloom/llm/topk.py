"""Exact top-k search by inner product as a Voronoi join.

A bounded set of pivots cuts the space into cells. Rows go to the cell of their nearest pivot; per cell, a count and a radius
are all that is gathered. From these follow, for each cell of queries, a score that its k-th neighbour surely reaches and, for
each cell of data, a score that it can't exceed. A data cell is copied only to those groups of query cells for which the second
is no less than the first. Groups of queries and their data are cut into blocks of bounded size, solved on their own by one
matrix product, and the blocks' k best are merged.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix

EXACT, LONG = float(1 << 53), float(1 << 62)
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Search:
    """``pivots``: the least number of cells; a quarter of the square root of the rows, up to ``most_pivots``, if that is more. Their vectors
    and summaries pass through the driver. ``queries`` and ``block``: rows of one local problem."""

    k: int = 20
    scale: float = 64.0
    pivots: int = 64
    most_pivots: int = 1024
    queries: int = 2048
    block: int = 8192


def _matrix(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their whole-number vectors (shorter ones end in zeros)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    ok = sizes >= 0
    row = np.repeat(np.arange(n), np.maximum(sizes, 0))
    ok[row[~np.isfinite(values)]] = False
    at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0), np.maximum(sizes, 0))
    out = np.zeros((n, int(sizes.max(initial=0))))
    good = ok[row]
    out[row[good], at[good]] = np.floor(values[good] * scale)
    return ok, out[ok]


def _wide(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] >= dims else np.hstack([x, np.zeros((len(x), dims - x.shape[1]))])


def _pack(x: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(x, np.float64).tobytes()
    size = x.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * size, size or 1, dtype=np.int32)[: len(x) + 1] if size else np.zeros(len(x) + 1, np.int32)), pa.py_buffer(data)])


def _unpack(column: pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    dims = max(map(len, parts), default=0) // 8
    return np.stack([np.pad(np.frombuffer(p), (0, dims - len(p) // 8)) for p in parts]) if parts else np.zeros((0, dims))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dims = max(a.shape[1], b.shape[1])
    a, b = _wide(a, dims), _wide(b, dims)
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(dims, 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    if most < LONG:
        return a.astype(np.int64) @ b.astype(np.int64).T
    # Beyond a long the products are Python's own whole numbers, exact at any size, and end where a long ends.
    xs, ys = ([[int(v) for v in row] for row in m] for m in (a, b))
    return np.array([[max(-LAST, min(LAST, sum(map(operator.mul, x, y)))) for y in ys] for x in xs], np.int64).reshape(len(xs), len(ys))


def needed(pivots: np.ndarray, count: np.ndarray, radius: np.ndarray, q_count: np.ndarray, q_radius: np.ndarray, k: int) -> np.ndarray:
    """``out[i, j]``: whether the data of cell j may hold a top-k neighbour of a query of cell i."""
    with np.errstate(over="ignore", invalid="ignore"):
        inner = pivots @ pivots.T
    norm = np.sqrt(np.maximum(np.diag(inner), 0))
    with np.errstate(over="ignore", invalid="ignore"):
        reach = q_radius[:, None] * norm[None, :] + (norm + q_radius)[:, None] * radius[None, :]
        # Room for the rounding of square roots and, with large numbers, of products.
        room = reach * (1 + 1e-9) + 1e-12 * (norm + q_radius)[:, None] * (norm + radius)[None, :]
        high, low = np.nan_to_num(inner + room, nan=np.inf), np.nan_to_num(inner - room, nan=-np.inf)
    out = np.zeros(inner.shape, bool)
    for i in np.flatnonzero(q_count):
        sure = -np.inf
        order = np.argsort(-low[i])
        enough = np.flatnonzero(np.cumsum(count[order]) >= k + 1)  # the query itself may be among them
        if len(enough):
            sure = low[i][order[enough[0]]]
        out[i] = (high[i] >= sure) & (count > 0)
    return out


def groups(pivots: np.ndarray, q_count: np.ndarray, most: int) -> np.ndarray:
    """Query cells joined to groups of about ``most`` queries, neighbours first; the group of each cell."""
    left = list(np.flatnonzero(q_count))
    group, now, size = np.full(len(q_count), -1), 0, 0
    at = left[0] if left else None
    while left:
        at = min(left, key=lambda j: float(((pivots[j] - pivots[at]) ** 2).sum()))
        left.remove(at)
        if size and size + q_count[at] > most:
            now, size = now + 1, 0
        group[at], size = now, size + q_count[at]
    return group


def top_k(vectors: DataFrame, is_query: Column, how: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``how.k`` best rows (all, if fewer) for each query, ties to the smaller id.

    Vectors become floor(scale * x). Null vectors, vectors with null or non-finite components and null ids take no part; a shorter
    vector counts as ending in zeros. Rows that share an id are rows of their own: each query row has its k best (and is told apart by no column), and all rows but itself are
    its candidates. Products are exact; a score beyond the range of a long counts as the end of that range.
    """
    scale, k = how.scale, how.k
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("q"), F.col(vector_col).alias("v"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = _matrix(b.column(2), scale)
            keep = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1).fill_null(False), _pack(x)], names=["id", "q", "x"])

    ready = rows.mapInArrow(whole, "id long, q boolean, x binary")
    wanted = max(how.pivots, min(how.most_pivots, math.isqrt(vectors.count()) // 4))
    chosen = ready.orderBy(F.xxhash64("id"), "id").limit(wanted).select("x").collect()  # a bounded number of vectors
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not chosen:
        return empty
    pivots = _unpack(pa.array([r.x for r in chosen], pa.binary()))
    square = (pivots**2).sum(1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unpack(b.column(2))
            dims = max(x.shape[1], pivots.shape[1])
            np.seterr(over="ignore", invalid="ignore")  # distances of large vectors are infinite: they go anywhere and are looked at by all
            away = square[None, :] - 2 * (_wide(x, dims) @ _wide(pivots, dims).T)
            cell = away.argmin(1)
            far = np.sqrt(((_wide(x, dims) - _wide(pivots, dims)[cell]) ** 2).sum(1)) if len(x) else np.zeros(0)
            far = np.nan_to_num(far, nan=np.inf)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=["id", "q", "x", "cell", "far"])

    # A row's number tells it from others of its id; it is fixed with the checkpoint.
    placed = cut(ready.mapInArrow(cells, "id long, q boolean, x binary, cell int, far double").withColumn("row", F.monotonically_increasing_id()))
    sums = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.count_if("q").alias("qn"), F.max(F.when(F.col("q"), F.col("far"))).alias("qr")).collect()  # one row a cell
    p = len(pivots)
    count, radius, q_count, q_radius = (np.zeros(p) for _ in range(4))
    for s in sums:
        count[s.cell], radius[s.cell], q_count[s.cell], q_radius[s.cell] = s.n, s.r, s.qn, s.qr or 0.0
    if not q_count.any():
        return empty
    need = needed(pivots, count, radius, q_count, q_radius, k)
    group = groups(pivots, q_count, how.queries)
    n_groups = int(group.max()) + 1
    member = np.zeros((n_groups, p), bool)
    for i in np.flatnonzero(q_count):
        member[group[i]] |= need[i]
    blocks = np.maximum(1, np.ceil(member @ count / how.block)).astype(int)
    parts = np.maximum(1, np.ceil(np.bincount(group[group >= 0], q_count[group >= 0], n_groups) / how.queries)).astype(int)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of each data row for each group (and part of its queries) that needs it; of each query row for each block."""
        for b in batches:
            cell, hashed = np.asarray(b.column(3)), mix(np.asarray(b.column(5), np.int64).view(np.uint64))
            for is_q in (False, True):
                take, keys = [], []
                for g in range(n_groups):
                    if is_q:
                        rows_ = np.flatnonzero(np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool) & (group[cell] == g))
                        part = (hashed[rows_] >> np.uint64(20)) % np.uint64(parts[g])
                        for block in range(blocks[g]):
                            take.append(rows_)
                            keys.append((g << 40) + (part.astype(np.int64) << 20) + block)
                    else:
                        rows_ = np.flatnonzero(member[g][cell])
                        block = (hashed[rows_] % np.uint64(blocks[g])).astype(np.int64)
                        for part in range(parts[g]):
                            take.append(rows_)
                            keys.append((g << 40) + (part << 20) + block)
                at, key = np.concatenate(take), np.concatenate(keys)
                for first in range(0, len(at), 4096):
                    some = at[first : first + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(key[first : first + 4096]), pa.array(np.full(len(some), is_q)), *[b.column(c).take(pa.array(some)) for c in (0, 2, 5)]], names=["key", "q", "id", "x", "row"])

    def solve(table: pa.Table) -> pa.Table:
        is_q = np.asarray(table.column("q").to_numpy(), bool)
        ids, row = np.asarray(table.column("id"), np.int64), np.asarray(table.column("row"), np.int64)
        out: list[list[np.ndarray]] = [[], [], [], []]
        x = _unpack(table.column("x"))
        data = np.flatnonzero(~is_q)
        data = data[np.lexsort((row[data], ids[data]))]
        theirs, points, own = ids[data], x[data], row[data]
        asked = np.flatnonzero(is_q)
        for first in range(0, len(asked) if len(data) else 0, 128):
            some = asked[first : first + 128]
            for q, n, score in zip(ids[some], row[some], _products(x[some], points)):
                ok = own != n
                score, cand = (score, theirs) if ok.all() else (score[ok], theirs[ok])
                if len(score) > k:
                    best = np.flatnonzero(score >= -np.partition(-score, k - 1)[k - 1])
                else:
                    best = np.arange(len(score))
                best = best[np.argsort(-score[best], kind="stable")][:k]
                for to, v in zip(out, (np.full(len(best), n), np.full(len(best), q), cand[best], score[best])):
                    to.append(v)
        return pa.table([pa.array(np.concatenate(o) if o else np.zeros(0, np.int64), pa.int64()) for o in out], names=["row", "query_id", "vec_id", "score"])

    dealt = placed.mapInArrow(deal, "key long, q boolean, id long, x binary, row long")
    best = dealt.groupBy("key").applyInArrow(solve, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
