"""Bank rules: versioned, prioritised conditions over transactions.

Rules are few and kept by people. They are read on the driver (``MOST_RULES`` at most, else an error) and compiled into column
expressions, so that matching is one projection over the transactions and no join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RULES = 1000
MOST_CONDITIONS = 12
MOST_PATTERN = 256
TEXT_CUT = 4096  # of a text, regular expressions see so many characters
TEXT_OPS = ("contains", "not_contains", "equals", "starts_with", "ends_with", "regex")
AMOUNT_OPS = ("equals", "gt", "gte", "lt", "lte", "between")


@dataclass(frozen=True)
class Condition:
    field: str  # description, amount or direction
    operator: str
    value: str = ""
    low: str | None = None
    high: str | None = None


@dataclass(frozen=True)
class Rule:
    rule_id: int
    version_id: int
    priority: int
    conditions: tuple[Condition, ...] = field(default=())
    account_id: int | None = None
    account_code: str | None = None
    name: str = ""


def pattern_error(pattern: str) -> str | None:
    """Why a pattern is refused: too long, lookaround, back-reference, or a quantified group that holds a quantifier."""
    if not pattern or len(pattern) > MOST_PATTERN:
        return "length"
    if re.search(r"\(\?[=!<]", pattern):
        return "lookaround"
    if re.search(r"\\[1-9]|\(\?P=", pattern):
        return "back-reference"
    depth: list[bool] = []
    k = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 2
            continue
        if c == "(":
            depth.append(False)
        elif c == ")" and depth:
            inner = depth.pop()
            after = pattern[k + 1 : k + 2]
            if inner and after and after in "*+{":
                return "nested quantifier"
            if depth and (inner or (after and after in "*+{")):
                depth[-1] = True
        elif c in "*+{" and depth:
            depth[-1] = True
        k += 1
    try:
        re.compile(pattern)
    except re.error:
        return "syntax"
    return None


def rule_errors(rule: Rule) -> list[str]:
    """What keeps a rule from being applied."""
    out = []
    if not 1 <= len(rule.conditions) <= MOST_CONDITIONS:
        out.append("conditions")
    for c in rule.conditions:
        allowed = {"description": TEXT_OPS, "amount": AMOUNT_OPS, "direction": ("equals",)}.get(c.field, ())
        if c.operator not in allowed:
            out.append(f"{c.field}.{c.operator}")
        elif c.operator == "regex" and (why := pattern_error(c.value)):
            out.append(f"regex: {why}")
    return out


def holds(c: Condition, description: Column, amount: Column) -> Column:
    """One condition; amounts compare by magnitude, direction by sign, text without regard to case."""
    if c.field == "description":
        text, value = F.lower(F.coalesce(description, F.lit(""))), c.value.lower()
        return {
            "contains": lambda: text.contains(value),
            "not_contains": lambda: ~text.contains(value),
            "equals": lambda: F.trim(text) == value.strip(),
            "starts_with": lambda: text.startswith(value),
            "ends_with": lambda: text.endswith(value),
            "regex": lambda: F.substring(text, 1, TEXT_CUT).rlike("(?i)" + c.value),
        }[c.operator]()
    if c.field == "direction":
        return (amount > 0) if c.value == "inflow" else (amount < 0)
    size = F.abs(amount)

    def at(v: str | None) -> Column:
        return F.abs(F.lit(v).cast("decimal(20,2)"))

    return {
        "equals": lambda: size == at(c.value),
        "gt": lambda: size > at(c.value),
        "gte": lambda: size >= at(c.value),
        "lt": lambda: size < at(c.value),
        "lte": lambda: size <= at(c.value),
        "between": lambda: size.between(F.least(at(c.low), at(c.high)), F.greatest(at(c.low), at(c.high))),
    }[c.operator]()


def _checked(rules: list[Rule]) -> list[Rule]:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most")
    return [r for r in rules if not rule_errors(r)]


def match_rules(transactions: DataFrame, rules: list[Rule], description: str = "description", amount: str = "amount") -> DataFrame:
    """A row for each transaction and rule of which all conditions hold: the transaction's columns, rule_id, version_id, priority, account_id."""
    hits = []
    for r in _checked(rules):
        ok = F.lit(True)
        for c in r.conditions:
            ok = ok & F.coalesce(holds(c, F.col(description), F.col(amount)), F.lit(False))
        # A priority of 0 acts as the default one.
        row = F.struct(F.lit(r.rule_id).cast("long").alias("rule_id"), F.lit(r.version_id).cast("long").alias("version_id"), F.lit(r.priority or 100).alias("priority"), F.lit(r.account_id).cast("long").alias("account_id"))
        hits.append(F.when(ok, row))
    if not hits:
        return transactions.where("false").selectExpr("*", "0L AS rule_id", "0L AS version_id", "0 AS priority", "0L AS account_id")
    each = F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull()))
    return transactions.withColumn("_hit", each).select(*transactions.columns, "_hit.*")


def resolve(transactions: DataFrame, rules: list[Rule], description: str = "description", amount: str = "amount") -> DataFrame:
    """One row for each transaction: status (matched, ambiguous, unresolved), rule_id, version_id, account_id, n_matched.

    The best priority wins; if several rules share it, the transaction is ambiguous and has no account.
    """
    hits = []
    for r in _checked(rules):
        ok = F.lit(True)
        for c in r.conditions:
            ok = ok & F.coalesce(holds(c, F.col(description), F.col(amount)), F.lit(False))
        hits.append(F.when(ok, F.struct(F.lit(r.priority or 100).alias("p"), F.lit(r.rule_id).cast("long").alias("rule_id"), F.lit(r.version_id).cast("long").alias("version_id"), F.lit(r.account_id).cast("long").alias("account_id"))))
    found = F.array_sort(F.filter(F.array(*hits), lambda h: h.isNotNull())) if hits else None
    if found is None:
        return transactions.selectExpr("*", "'unresolved' AS status", "CAST(NULL AS LONG) AS rule_id", "CAST(NULL AS LONG) AS version_id", "CAST(NULL AS LONG) AS account_id", "0 AS n_matched")
    rows = transactions.withColumn("_m", found)
    best = F.get("_m", F.lit(0))
    tied = F.size(F.filter("_m", lambda h: h["p"] == F.get("_m", F.lit(0))["p"])) > 1
    status = F.when(F.size("_m") == 0, "unresolved").when(tied, "ambiguous").otherwise("matched")
    only = status == "matched"
    return rows.select(
        *transactions.columns,
        status.alias("status"),
        *[F.when(only, best[c]).alias(c) for c in ("rule_id", "version_id", "account_id")],
        F.size("_m").alias("n_matched"),
    )


def test_rule(transactions: DataFrame, rule: Rule, samples: int = 25, key: str = "idx") -> tuple[DataFrame, DataFrame]:
    """Counts (tested, matched) over all transactions, and a report of the first ``samples`` that match."""
    matched = match_rules(transactions, [rule])
    counts = transactions.agg(F.count("*").alias("tested")).crossJoin(matched.agg(F.count("*").alias("matched")))  # one row each
    return counts, matched.orderBy(key).limit(samples)


def latest_approved(versions: DataFrame) -> DataFrame:
    """Of the approved versions (rule_id, version_number, approval_status, ...) the highest of each rule."""
    by = Window.partitionBy("rule_id").orderBy(F.desc("version_number"))
    return versions.where("approval_status = 'approved'").withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def next_versions(versions: DataFrame) -> DataFrame:
    """rule_id, next_version, has_open_draft (a rule with one takes no other)."""
    return versions.groupBy("rule_id").agg((F.max("version_number") + 1).alias("next_version"), F.bool_or(F.col("approval_status") == "draft").alias("has_open_draft"))


def approve(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Versions after the drafts in ``chosen`` (rule_id, version_number) are approved; the rules' earlier approved versions become superseded."""
    mark = chosen.select("rule_id", F.col("version_number").alias("_v"))
    joined = versions.join(mark, "rule_id", "left")
    status = (
        F.when((F.col("version_number") == F.col("_v")) & (F.col("approval_status") == "draft"), "approved")
        .when(F.col("_v").isNotNull() & (F.col("approval_status") == "approved") & (F.col("version_number") != F.col("_v")), "superseded")
        .otherwise(F.col("approval_status"))
    )
    return joined.withColumn("approval_status", status).select(*versions.columns)
