"""Evaluation: every threshold of a grid from one pass, and measures of predictions at the thresholds that were chosen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_grid(scored: DataFrame, grid: list[float], task: str = "task", score: str = "score", truth: str = "truth") -> DataFrame:
    """task, threshold, tp, fp, fn, precision, recall, f1 for every task and every threshold of ``grid``; a score counts from its threshold on.

    Scores are counted once by how many thresholds they reach; sums from the top of these counts give all grid points, so that the cost is that of one threshold. Null
    scores reach none; null truths count as false.
    """
    steps = sorted(set(grid))
    reached = sum((F.coalesce(F.col(score) >= t, F.lit(False)).cast("int") for t in steps), F.lit(0))
    hit = F.coalesce(F.col(truth), F.lit(False)).cast("long")
    counts = scored.groupBy(F.col(task), reached.alias("_i")).agg(F.count("*").alias("_n"), F.sum(hit).alias("_p"))
    # A task has a row for each step, also where no score lies.
    points = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("_i"), F.lit(float(t)).alias("threshold")) for k, t in enumerate(steps)]))
    base = counts.groupBy(task).agg(F.sum("_p").alias("_all")).select(task, "_all", points.alias("_x")).select(task, "_all", "_x.*")
    rows = base.join(counts, [task, "_i"], "left").fillna(0, ["_n", "_p"])
    down = Window.partitionBy(task).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("tp", F.sum("_p").over(down)).withColumn("fp", F.sum("_n").over(down) - F.col("tp")).withColumn("fn", F.col("_all") - F.col("tp"))
    return rows.select(task, "threshold", "tp", "fp", "fn", *[x.alias(n) for n, x in _ratios(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def _ratio(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def _ratios(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)}


def best_thresholds(points: DataFrame, task: str = "task", by: str = "f1") -> DataFrame:
    """task, threshold and the measure of each task's best grid point; ties to the smaller threshold."""
    best = F.min(F.struct((-F.col(by)).alias("_m"), "threshold"))
    return points.groupBy(task).agg(best.alias("_b")).select(task, "_b.threshold", (-F.col("_b._m")).alias(by))


def multi_metrics(rows: DataFrame, labels: int, truth: str = "truth", guess: str = "guess", ranked: str | None = None, k: int = 5) -> DataFrame:
    """One row of a multi-label task: n, micro_f1, samples_f1, hamming_loss, exact_match and, with ``ranked`` (labels, best first), recall_at_k.

    Null sets are empty. Two empty sets agree: they count in exact_match, and as 0 in samples_f1. ``labels`` is how many there are.
    """
    none = F.array().cast(dict(rows.dtypes)[truth])
    t, g = F.array_distinct(F.coalesce(F.col(truth), none)), F.array_distinct(F.coalesce(F.col(guess), none))
    both = F.size(F.array_intersect(t, g))
    each = rows.select(both.alias("both"), F.size(t).alias("t"), F.size(g).alias("g"), (F.size(F.array_intersect(t, F.slice(F.coalesce(F.col(ranked), none), 1, k))) if ranked else F.lit(None).cast("int")).alias("top"))
    out = each.agg(
        F.count("*").alias("n"),
        _ratio(2 * F.sum("both"), F.sum(F.col("t") + F.col("g"))).alias("micro_f1"),
        F.round(F.avg(F.when(F.col("t") + F.col("g") > 0, 2 * F.col("both") / (F.col("t") + F.col("g"))).otherwise(0.0)), 6).alias("samples_f1"),
        F.round(F.sum(F.col("t") + F.col("g") - 2 * F.col("both")) / (F.count("*") * labels), 6).alias("hamming_loss"),
        F.round(F.avg(((F.col("both") == F.col("t")) & (F.col("both") == F.col("g"))).cast("double")), 6).alias("exact_match"),
        F.round(F.avg(F.when(F.col("t") > 0, F.col("top") / F.col("t"))), 6).alias("recall_at_k"),
    )
    return out if ranked else out.drop("recall_at_k")


def joint_exact_match(rows: DataFrame, tasks: dict[str, tuple[str, str]], split: str = "split") -> DataFrame:
    """split, n and the share of rows in which all ``tasks`` (truth and guess column of each) are right; arrays are compared as sets."""

    def right(truth: str, guess: str) -> Column:
        if dict(rows.dtypes)[truth].startswith("array"):
            a, b = (F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[truth])))) for c in (truth, guess))
            return a == b
        return F.col(truth).eqNullSafe(F.col(guess))

    every = F.lit(True)
    for truth, guess in tasks.values():
        every = every & right(truth, guess)
    return rows.groupBy(split).agg(F.count("*").alias("n"), F.round(F.avg(every.cast("double")), 6).alias("joint_exact_match"))


def gaps(measures: DataFrame, keys: list[str], value: str, split: str = "split", first: str = "validation", second: str = "test") -> DataFrame:
    """``keys``, the two splits' values and ``gap``: by how much the first split is better than the second."""
    of = {s: F.max(F.when(F.col(split) == s, F.col(value))) for s in (first, second)}
    out = measures.groupBy(*keys).agg(*[c.alias(s) for s, c in of.items()])
    return out.select(*keys, first, second, F.round(F.col(first) - F.col(second), 6).alias("gap"))
