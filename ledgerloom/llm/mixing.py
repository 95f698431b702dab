"""Mixing sources to target weights by hierarchical budgeting.

Weights hang on a tree domain - language - source. A node's capacity is what its documents hold over all epochs. A token budget
goes down the tree: children share their parent's tokens by weight, none above its capacity, and what one cannot take goes to
its siblings first (water filling); only what a whole family cannot take stays with the parent's own siblings. A leaf then takes
whole epochs and, of the last one, the documents of smallest seeded hash: the longest prefix that stays within its tokens.
Only DataFrame functions; all sums are whole numbers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, by_key, cut

LEVELS = ("_domain", "_lang", "_source")
SMALL_TABLE = 10_000  # leaves up to which the table of leaves is broadcast; beyond it the join shuffles


def default_domain(source: Column) -> Column:
    """Sources with an even last digit are 'web', with an odd one 'books', and others 'other'."""
    digit = F.regexp_extract(source, r"([0-9])$", 1)
    return F.when(digit == "", "other").when(digit.isin("0", "2", "4", "6", "8"), "web").otherwise("books")


def n_words(text: Column) -> Column:
    """Words of a text, a document's tokens here; null counts none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WORD_SPACE, " " * len(WORD_SPACE))
    return F.size(F.filter(F.split(spaced, " "), lambda x: x != "")).cast("long")


def share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (parent columns, name, weight, capacity, tokens of the parent in ``_given``) with ``given`` of each node.

    A node is full if its capacity does not exceed the fair part of what is left by the nodes that fill up before it. Nodes are
    ordered by capacity over weight; rounding is down, so a few tokens may stay unused. Weight 0 gets nothing.
    """
    by = Window.partitionBy(*parent).orderBy(F.expr("CAST(capacity AS DECIMAL(38, 12)) / weight"), "name")
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    open_ = nodes.where("weight > 0").withColumn("_left", F.col("_given") - F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("_weights", F.sum("weight").over(after))
    # Full nodes come first in this order; from the first one that is not full on, all share by weight what is left there.
    fair = open_.withColumn("_full", F.expr("CAST(capacity AS DECIMAL(38, 0)) * _weights <= CAST(_left AS DECIMAL(38, 0)) * weight"))
    first = Window.partitionBy(*parent)
    fair = fair.withColumn("_open", F.min(F.when(~F.col("_full"), F.struct(F.expr("CAST(capacity AS DECIMAL(38, 12)) / weight").alias("k"), F.col("name").alias("n"), F.col("_left").alias("l"), F.col("_weights").alias("w")))).over(first))
    part = F.expr("CAST((CAST(_open.l AS DECIMAL(38, 0)) * weight) DIV _open.w AS BIGINT)")
    return fair.withColumn("given", F.when(F.col("_full"), F.col("capacity")).otherwise(F.greatest(part, F.lit(0)))).drop("_left", "_weights", "_full", "_open", "_given")


def budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], total: Column, epochs: int) -> DataFrame:
    """Per leaf (domain, lang, source): docs, tokens, capacity and given. ``weights``: by level ('domain', 'lang', 'source') and name; 1 if not named.

    ``leaves`` has one row per leaf with docs and tokens. The tables here have one row per node of the tree.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)

    def weight(level: str, name: Column) -> Column:
        named = weights.get(level, {})
        return reduce(lambda c, kv: c.when(name == kv[0], F.lit(kv[1]).cast("long")), named.items(), F.when(F.lit(False), F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long")) if named else F.lit(1).cast("long")

    given = leaves.agg(F.sum("capacity").alias("_all")).select(F.least(F.col("_all"), total).alias("_given"))
    path: list[str] = []
    for level, name in zip(LEVELS, ("domain", "lang", "source")):
        nodes = leaves.groupBy(*path, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight(name, F.col(level))).withColumn("name", F.col(level))
        nodes = nodes.join(given, path) if path else nodes.crossJoin(given)  # one row
        parent = list(path)
        path.append(level)
        given = share(nodes, parent or [F.lit(0)]).select(*path, F.col("given").alias("_given"))
    return leaves.join(given.withColumnRenamed("_given", "given"), list(LEVELS), "left").fillna({"given": 0})


def plan(docs: DataFrame, weights: dict[str, dict[str, int]], part_percent: int = 50, epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions per document and per leaf.

    Documents: id, ``_domain``, ``_lang``, ``_source``, ``n_tokens``, ``order`` (hex digits), and ``copies``: how often the document
    is taken. Leaves: docs, tokens, capacity, given, ``whole`` epochs, ``rest`` tokens of the last one.
    The budget is ``part_percent`` of the tokens of one epoch. Null languages and sources are leaves of their own.
    A leaf's order is cut into 4 096 ranges of the hash, so no task has to sort a leaf: range sums find the range in which the
    prefix ends, and only that range's documents are summed one by one.
    """
    own = domain if domain is not None else default_domain(F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col),
        F.coalesce(own, F.lit("")).alias("_domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        n_words(F.col(text_col)).alias("n_tokens"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("order"),
    )
    rows = cut(rows.withColumn("_range", F.substring("order", 1, 3)))
    ranges = cut(rows.groupBy(*LEVELS, "_range").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d")))
    leaves = ranges.groupBy(*LEVELS).agg(F.sum("d").alias("docs"), F.sum("t").alias("tokens"))
    all_tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
    total = F.lit(all_tokens * part_percent // 100).cast("long")
    leaf = budgets(leaves, weights, total, epochs)
    leaf = leaf.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("given DIV tokens")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("given") - F.col("whole") * F.col("tokens"))
    leaf = cut(leaf)
    upto = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.withColumn("before", F.coalesce(F.sum("t").over(upto), F.lit(0))).join(leaf.select(*LEVELS, "rest"), list(LEVELS))
    ends = ends.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).groupBy(*LEVELS, "rest").agg(F.min(F.struct("_range", "before")).alias("_e"))
    n = leaf.count()
    small = (lambda t: F.broadcast(t)) if n <= SMALL_TABLE else (lambda t: t)
    ends = ends.select(*LEVELS, "rest", F.col("_e._range").alias("_range"), F.col("_e.before").alias("before"))
    inside = rows.join(small(ends), [*LEVELS, "_range"])
    sums = Window.partitionBy(*LEVELS, "_range").orderBy("order", id_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = inside.withColumn("_upto", F.col("before") + F.sum("n_tokens").over(sums)).where(F.col("_upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max(F.struct("order", F.col(id_col).alias("id"))).alias("_last"))
    cuts = leaf.select(*LEVELS, "whole", "rest").join(ends.select(*LEVELS, F.col("_range").alias("_end")), list(LEVELS), "left").join(last, list(LEVELS), "left")
    cuts = cut(cuts)
    taken = rows.join(small(cuts), list(LEVELS))
    # Ids of equal hash are ordered by the id; a prefix ends at one pair of the two. Rows that share both go together.
    upto_last = F.coalesce((F.col("order") < F.col("_last.order")) | ((F.col("order") == F.col("_last.order")) & (F.col(id_col) <= F.col("_last.id"))), F.lit(False))
    in_prefix = F.when(F.col("rest") <= 0, F.lit(False)).when(F.col("_end").isNull(), F.lit(True)).otherwise((F.col("_range") < F.col("_end")) | upto_last)
    decided = taken.withColumn("copies", (F.col("whole") + F.when(in_prefix, 1).otherwise(0)).cast("long"))
    return decided.select(id_col, *LEVELS, "n_tokens", "order", "copies"), leaf


def mix(docs: DataFrame, weights: dict[str, dict[str, int]], part_percent: int = 50, epochs: int = 1, seed: int = 7, id_col: str = "doc_id", **named) -> DataFrame:
    """The rows of ``docs``, all columns, as often as they are taken (at most ``epochs`` times); ids are taken to be unique."""
    decided, _ = plan(docs, weights, part_percent, epochs, seed, id_col, **named)
    chosen = decided.where("copies > 0").select(F.col(id_col).alias("_id"), F.col("copies").alias("_copies"))
    rows, same = by_key(docs, id_col), F.col("_key").eqNullSafe(F.col("_id"))
    if epochs == 1:
        return rows.join(chosen, same, "left_semi").select("_row.*")
    return rows.join(chosen, same).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")
