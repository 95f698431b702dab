"""Retrieval of similar entries and votes over what was found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import top_by

QUERIES, ROWS = 2048, 16_384  # vectors of one product


def _unit(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors (zeros behind shorter ones), the size of each, and which have a length; a vector with a null component, or none at all, has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(np.nan), np.float64)
    out = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = flat
    norm = np.sqrt((out * out).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    out[~good] = 0.0
    out[good] /= norm[good, None]
    return out, size, good


def nearest(queries: DataFrame, history: DataFrame, k: int, least: float = 0.0, query_id: str = "query_id", row_id: str = "row_id", vector: str = "vector") -> DataFrame:
    """query, row, score (cosine, four digits, 0 at least) and rank of each query's ``k`` best rows at or above ``least``; ties to the smaller row.

    Both sides are dealt to a grid of blocks of about ``QUERIES`` and ``ROWS`` vectors (by counts; rows that share an id may share a block). A block is one task: unit vectors, one
    matrix product at a time, and each query's ``k`` best go on. Nothing is broadcast, and no block grows with the data. Vectors of other sizes than the query's, without length or
    with nulls score 0; the query's own id, and null ids, take no part.
    """
    kinds = dict(queries.dtypes)[query_id], dict(history.dtypes)[row_id]
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("_q"), F.col(vector).cast("array<double>").alias("_v"))
    past = history.where(F.col(row_id).isNotNull()).select(F.col(row_id).alias("_r"), F.col(vector).cast("array<double>").alias("_v"))
    n, m = max(1, -(-asked.count() // QUERIES)), max(1, -(-past.count() // ROWS))

    def dealt(side: DataFrame, column: str, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            (a, a_size, _), (b, b_size, _) = _unit(left.column("_v")), _unit(right.column("_v"))
            dims = max(a.shape[1], b.shape[1])
            a, b = (np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (a, b))
            q, r = left.column("_q").to_pandas().to_numpy(), right.column("_r").to_pandas().to_numpy()
            order = np.argsort(r, kind="stable")
            b, b_size, r = b[order], b_size[order], r[order]
            for first in range(0, len(a), 256):
                part = slice(first, first + 256)
                score = np.where(a_size[part, None] == b_size[None, :], a[part] @ b.T, 0.0)
                score = np.floor(np.clip(score, 0.0, 1.0) * 10_000 + 0.5) / 10_000
                for who, line in zip(q[part], score):
                    some = np.flatnonzero((line >= least) & (r != who))
                    if len(some) > k:
                        some = some[line[some] >= -np.partition(-line[some], k - 1)[k - 1]]
                    some = some[np.argsort(-line[some], kind="stable")][:k]
                    for to, v in zip(found, ([who] * len(some), r[some].tolist(), line[some].tolist())):
                        to.extend(v)
        return pa.table([pa.array(found[0], left.schema.field("_q").type), pa.array(found[1], right.schema.field("_r").type), pa.array(found[2], pa.float64())], names=[query_id, row_id, "score"])

    left, right = dealt(asked, "_q", "_x", n, "_y", m), dealt(past, "_r", "_y", m, "_x", n)
    pairs = left.groupBy("_x", "_y").cogroup(right.groupBy("_x", "_y")).applyInArrow(best, f"`{query_id}` {kinds[0]}, `{row_id}` {kinds[1]}, score double")
    return top_by(pairs, [query_id], k, F.desc("score"), row_id)


def weighted_vote(found: DataFrame, labels: str = "labels", query_id: str = "query_id", score: str = "score") -> DataFrame:
    """query, label, vote: a row's score is shared by its distinct labels; votes are shares of the scores of rows with labels, 1 at most."""
    clean = F.array_distinct(F.filter(F.col(labels), lambda x: x.isNotNull()))
    rows = found.withColumn("_l", clean).where(F.size("_l") > 0)
    total = Window.partitionBy(query_id)
    rows = rows.withColumn("_t", F.sum(score).over(total)).withColumn("_w", F.col(score) / F.size("_l"))
    out = rows.select(query_id, "_t", "_w", F.explode("_l").alias("label")).groupBy(query_id, "label").agg(F.sum("_w").alias("_s"), F.max("_t").alias("_t"))
    return out.where("_t > 0").select(query_id, "label", F.round(F.least(F.lit(1.0), F.col("_s") / F.col("_t")), 6).alias("vote"))


def knn_vote(found: DataFrame, label: str = "label", query_id: str = "query_id", score: str = "score") -> DataFrame:
    """query, label, share of the similarities (1e-6 at least each)."""
    sim = F.greatest(F.col(score), F.lit(1e-6))
    sums = found.groupBy(query_id, label).agg(F.sum(sim).alias("_s"))
    return sums.select(query_id, label, F.round(F.col("_s") / F.sum("_s").over(Window.partitionBy(query_id)), 6).alias("share"))


def hash_embedding(texts: DataFrame, key: str, text: str, dims: int = 1024) -> DataFrame:
    """key, dim, weight: a sparse signed hash embedding of length one.

    Each token's SHA-256 gives its dimension (first four bytes) and sign (parity of the fifth).
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    each = texts.select(key, F.explode(tokens).alias("_t")).withColumn("_h", F.sha2("_t", 256))
    dim = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") % dims
    sign = F.when(F.conv(F.substring("_h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = each.groupBy(key, dim.alias("dim")).agg(F.sum(sign).alias("_w")).where("_w != 0")
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return sums.select(key, "dim", F.round(F.col("_w") / norm, 9).alias("weight"))


def classification_metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: n, accuracy, balanced_accuracy, macro_f1, weighted_f1 from counts of truth and guess."""
    pairs = rows.groupBy(F.col(truth).cast("string").alias("t"), F.col(guess).cast("string").alias("g")).agg(F.count("*").alias("n"))
    truths = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0)).alias("tp"))
    guesses = pairs.groupBy(F.col("g").alias("label")).agg(F.sum("n").alias("guessed"))
    each = truths.join(guesses, "label", "full").fillna(0)
    f1 = F.when(F.col("support") + F.col("guessed") > 0, 2 * F.col("tp") / (F.col("support") + F.col("guessed"))).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support"))
    return each.agg(
        F.sum("support").alias("n"),
        F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"),
        F.round(F.avg(recall), 6).alias("balanced_accuracy"),
        F.round(F.avg(f1), 6).alias("macro_f1"),
        F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
    )
