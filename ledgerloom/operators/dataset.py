"""A supervised dataset: splits that cannot leak, targets with the names of their catalogs, and gates that say whether it may be used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .suggest import connected

SPLITS = (("train", 80), ("validation", 10), ("test", 10))


def split_of(group: Column, shares: tuple[tuple[str, int], ...] = SPLITS, seed: str = "") -> Column:
    """The split of a group's id, by its MD5: shares of a hundred, in their order."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), group.cast("string"))), 1, 8), 16, 10).cast("long") % 100
    out, upto = F.lit(None).cast("string"), sum(n for _, n in shares)
    if upto != 100:
        raise ValueError("shares have to add up to a hundred")
    for name, n in reversed(shares):
        out = F.when(at < upto, name).otherwise(out)
        upto -= n
    return out


def leakfree(examples: DataFrame, contents: DataFrame, shares: tuple[tuple[str, int], ...] = SPLITS, seed: str = "") -> DataFrame:
    """``examples`` (id first) with component and split: examples that share a content (id, hash), or are joined by a chain of shared ones, are in one split.

    Contents that one example alone has join nothing and are left out before components are sought; so are null ones. An example without shared contents is a component of its own.
    Ids are taken to be unique.
    """
    key = examples.columns[0]
    links = contents.select(F.col(contents.columns[0]).cast("long").alias("a"), F.col(contents.columns[1]).cast("string").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()
    shared = links.groupBy("b").agg(F.count("*").alias("_n")).where("_n > 1").select("b")
    sets = connected(links.join(shared, "b", "left_semi")).select(F.col("a").alias("_id"), F.col("set").alias("_set"))
    out = examples.join(sets, F.col(key) == F.col("_id"), "left").drop("_id")
    return out.withColumn("component", F.coalesce("_set", F.col(key).cast("long"))).drop("_set").withColumn("split", split_of(F.col("component"), shares, seed))


def with_names(examples: DataFrame, catalogs: dict[str, DataFrame]) -> DataFrame:
    """id, and for each of ``catalogs`` (by the column of ``examples`` that holds its ids, an array) ``column_names`` (in the order of ids) and ``unresolved``: column:id of what no catalog has.

    All columns are looked up together: one join on (column, id), one grouping. A catalog (id, name) with an id twice gives its least name.
    """
    key = examples.columns[0]
    asked = reduce(DataFrame.unionByName, [examples.select(F.col(key).alias("_k"), F.lit(c).alias("_c"), F.explode(F.array_distinct(F.col(c).cast("array<bigint>"))).alias("_i")) for c in catalogs])
    known = reduce(DataFrame.unionByName, [d.groupBy(F.col(d.columns[0]).cast("long").alias("_i")).agg(F.min(d.columns[1]).alias("_name")).withColumn("_c", F.lit(c)).withColumn("_in", F.lit(True)) for c, d in catalogs.items()])
    rows = asked.where("_i IS NOT NULL").join(known, ["_c", "_i"], "left")
    found = [F.transform(F.array_sort(F.collect_list(F.when((F.col("_c") == c) & F.col("_in"), F.struct("_i", "_name")))), lambda x: x["_name"]).alias(f"{c}_names") for c in catalogs]
    missing = F.array_sort(F.collect_list(F.when(F.col("_in").isNull(), F.concat_ws(":", "_c", F.col("_i").cast("string"))))).alias("unresolved")
    grouped = rows.groupBy("_k").agg(*found, missing)
    none = F.array().cast("array<string>")
    out = examples.select(F.col(key)).join(grouped, F.col(key) == F.col("_k"), "left")
    return out.select(key, *[F.coalesce(c, none).alias(c) for c in (*[f"{c}_names" for c in catalogs], "unresolved")])


def gates(dataset: DataFrame, contents: DataFrame, least: dict[str, int], most_unresolved: int = 0) -> DataFrame:
    """gate, value, ok: what has to hold before the dataset (id first, split, unresolved) is used.

    unique_ids: ids beyond one row each; leaked_contents: contents (id, hash) that stand in two splits; ``rows_`` and a split: its rows, ``least`` of them at least; unresolved: ids that no catalog has;
    unlabelled: rows without a split.
    """
    key = dataset.columns[0]
    sums = dataset.agg((F.count(key) - F.countDistinct(key)).alias("unique_ids"), F.coalesce(F.sum(F.size("unresolved")), F.lit(0)).alias("unresolved"), F.count_if(F.col("split").isNull()).alias("unlabelled"), *[F.count_if(F.col("split") == s).alias(f"rows_{s}") for s in least])
    of = contents.select(F.col(contents.columns[0]).alias("_id"), F.col(contents.columns[1]).alias("_h")).where("_h IS NOT NULL")
    spread = of.join(dataset.select(F.col(key).alias("_key"), "split"), F.col("_id") == F.col("_key")).groupBy("_h").agg(F.countDistinct("split").alias("n"))
    leaked = spread.agg(F.count_if(F.col("n") > 1).alias("leaked_contents"))
    wide = sums.crossJoin(leaked)  # one row each
    rules = {"unique_ids": F.col("unique_ids") == 0, "leaked_contents": F.col("leaked_contents") == 0, "unresolved": F.col("unresolved") <= most_unresolved, "unlabelled": F.col("unlabelled") == 0, **{f"rows_{s}": F.col(f"rows_{s}") >= n for s, n in least.items()}}
    each = F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), F.col(g).cast("long").alias("value"), ok.alias("ok")) for g, ok in rules.items()]))
    return wide.select(each.alias("x")).select("x.*")
