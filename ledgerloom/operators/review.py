"""Review queues, expiry, catalog scopes and label sets of moves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The states of a daily review and what moves it on.
TRANSITIONS = (
    ("pending_audit", "errors", "needs_revision"),
    ("pending_audit", "passed", "awaiting_human_approval"),
    ("needs_revision", "resubmitted", "pending_audit"),
    ("awaiting_human_approval", "approved", "approved"),
    ("awaiting_human_approval", "returned", "needs_revision"),
)


def next_state(state: Column, event: Column) -> Column:
    """The state after ``event``; null where the event is not allowed in ``state``."""
    known = [F.when((state == a) & (event == e), F.lit(b)) for a, e, b in TRANSITIONS]
    return F.coalesce(*known)


def in_scope(rows: DataFrame, company: int, column: str = "company_id") -> DataFrame:
    """Rows of one company and those that no company owns."""
    return rows.where(F.col(column).isNull() | (F.col(column) == company))


def expire(rows: DataFrame, now: Column, status: str = "status", expires: str = "expires_at") -> DataFrame:
    """Pending rows whose time is over become 'expired'."""
    return rows.withColumn(status, F.when((F.col(status) == "pending") & (F.col(expires) <= now), "expired").otherwise(F.col(status)))


def alias_of(name: Column, aliases: dict[str, str], default: str) -> Column:
    """The canonical name of an alias, regardless of case and outer blanks."""
    key = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return reduce(lambda c, kv: c.when(key == kv[0], F.lit(kv[1])), aliases.items(), F.when(F.lit(False), F.lit(""))).otherwise(F.lit(default))


def label_sets(lines: DataFrame, move: str = "move_id", account: str = "account") -> DataFrame:
    """Per move the sorted distinct accounts on either side, and its number of lines."""
    sides = {side: F.array_sort(F.collect_set(F.when(F.col(side) > 0, F.col(account)))) for side in ("debit", "credit")}
    return lines.groupBy(move).agg(sides["debit"].alias("debit_accounts"), sides["credit"].alias("credit_accounts"), F.count("*").alias("n_lines"))


def sheet_balance(cells: DataFrame, sheet: str, debit: str, credit: str) -> DataFrame:
    """Per sheet the sums of debit and credit texts that are numbers, and whether they agree within a hundredth."""
    total = {c: F.coalesce(F.sum(F.col(c).try_cast("decimal(20,2)")), F.lit(0)).cast("decimal(28,2)") for c in (debit, credit)}
    out = cells.groupBy(sheet).agg(total[debit].alias("total_debit"), total[credit].alias("total_credit"))
    return out.withColumn("balanced", F.abs(F.col("total_debit") - F.col("total_credit")) <= F.lit("0.01").cast("decimal(4,2)"))


def multi_label_mean(found: DataFrame, labels: str, query_id: str = "query_id", score: str = "score") -> DataFrame:
    """query, label, share: the weighted part of a query's neighbours that carry the label, weights 1e-6 at least."""
    weighed = found.withColumn("_w", F.greatest(F.col(score), F.lit(1e-6)))
    weighed = weighed.withColumn("_t", F.sum("_w").over(Window.partitionBy(query_id)))
    each = weighed.select(query_id, "_w", "_t", F.explode(F.array_distinct(labels)).alias("label"))
    return each.groupBy(query_id, "label").agg(F.round(F.sum("_w") / F.max("_t"), 6).alias("share"))


def gate(rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``rows`` with ``blocked``: names of the scores below their thresholds, sorted, and ``allowed`` (none of them)."""
    low = [F.when(F.coalesce(F.col(c), F.lit(0.0)) < t, F.lit(c)) for c, t in sorted(thresholds.items())]
    out = rows.withColumn("blocked", F.array_join(F.filter(F.array(*low), lambda x: x.isNotNull()), ","))
    return out.withColumn("allowed", F.col("blocked") == "")


def best_partner(names: DataFrame, partners: DataFrame, key: str, name: str, partner_id: str, partner: str, least: float = 0.5) -> DataFrame:
    """key, partner id and Dice similarity (of bigrams, regardless of case) of the most similar partner at or above ``least``; ties to the smaller id.

    A prefix filter without loss: two names that reach ``least`` have so many numbered bigrams in common that one of the rarest
    of either (in one fixed order) is among the first of the other, so the pairs come from an equi-join; equal names go once.
    """
    def numbered(text: Column) -> Column:
        size = F.length(text)
        grams = F.transform(F.when(size >= 2, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(2)))
        return F.transform(grams, lambda g, i: F.concat(F.lpad(F.size(F.filter(F.slice(grams, F.lit(1), i + 1), lambda h: h == g)).cast("string"), 3, "0"), F.md5(g)))

    def sides(rows: DataFrame, column: str) -> DataFrame:
        each = rows.select(F.lower(column).alias("_t")).where("_t IS NOT NULL").distinct().withColumn("_g", F.sort_array(numbered(F.col("_t")), False))
        n = F.size("_g")
        # The other has n * least / (2 - least) bigrams or more, and least / 2 of both together are shared.
        need = F.ceil(F.lit(least / (2 - least)) * n - 1e-9)
        first = F.slice("_g", F.lit(1), F.greatest((n - need + 1).cast("int"), F.lit(0)))
        return each.select("_t", "_g", F.explode(F.concat(first, F.array(F.concat(F.lit("="), F.md5("_t"))))).alias("_p"))

    left = sides(names, name)
    right = sides(partners, partner).select(F.col("_t").alias("_u"), F.col("_g").alias("_h"), "_p")
    pairs = left.join(right, "_p").select("_t", "_u", "_g", "_h").dropDuplicates(["_t", "_u"])
    dice = F.when(F.col("_t") == F.col("_u"), 1.0).when((F.size("_g") == 0) | (F.size("_h") == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect("_g", "_h")) / (F.size("_g") + F.size("_h")))
    scored = pairs.select("_t", "_u", F.round(dice, 6).alias("similarity")).where(F.col("similarity") >= least)
    firsts = partners.groupBy(F.lower(partner).alias("_u")).agg(F.min(partner_id).alias("_pid"))
    best = scored.join(firsts, "_u").groupBy("_t").agg(F.min_by(F.struct("_pid", "similarity"), F.struct(-F.col("similarity"), F.col("_pid"))).alias("_b"))
    return names.join(best, F.lower(name) == F.col("_t")).select(key, F.col("_b._pid").alias("partner_id"), F.col("_b.similarity").alias("similarity"))
