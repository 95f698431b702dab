"""Catalog lookups, duplicate checks, upserts and rankings. Every order names a tiebreaker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text_index import TextIndex


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_by(rows: DataFrame, keys: list[str], n: int, *order: Column | str, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key, numbered from 1."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def top_scores(rows: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """``key``, ``score``, ``tie`` and rank of each key's ``k`` greatest scores, ties to the smaller ``tie``; for numbers without nulls, and keys with many more rows than ``k``.

    Each Arrow batch lets the ``k`` best of every key through before anything is sorted or shuffled. As a join yields a key's rows one after another, few of many rows go on.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, s, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (key, score, tie))
            order = np.lexsort((b, -s, a))
            sorted_keys = a[order]
            first = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(a) else np.zeros(0, np.int64)
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
            yield batch.take(pa.array(np.sort(order[rank < k])))

    some = rows.select(key, score, tie)
    return top_by(some.mapInArrow(best, some.schema), [key], k, F.desc(score), tie)



def resolve_ids(rows: DataFrame, catalog: DataFrame, key: str, catalog_key: str = "id") -> DataFrame:
    """All rows with the catalog's columns and ``resolved``; what is not in the catalog stays, flagged."""
    found = catalog.withColumn("_in", F.lit(True))
    return rows.join(found, F.col(key) == F.col(catalog_key), "left").withColumn("resolved", F.coalesce("_in", F.lit(False))).drop("_in")


def resolve_labels(labels: DataFrame, catalog: DataFrame, label: str = "label") -> DataFrame:
    """label and id: by code regardless of case, else by name; the catalog's first row (by id) of a code or name wins."""
    by_code = first_by(catalog.where("code IS NOT NULL").withColumn("_k", F.lower(F.trim("code"))), ["_k"], "id").select("_k", F.col("id").alias("_by_code"))
    by_name = first_by(catalog.where("name IS NOT NULL").withColumn("_k", F.lower(F.trim("name"))), ["_k"], "id").select("_k", F.col("id").alias("_by_name"))
    rows = labels.withColumn("_k", F.lower(F.trim(label)))
    return rows.join(by_code, "_k", "left").join(by_name, "_k", "left").withColumn("id", F.coalesce("_by_code", "_by_name")).drop("_k", "_by_code", "_by_name")


def unique_or_error(requests: DataFrame, catalog: DataFrame, key: str, catalog_key: str, id_col: str = "id") -> DataFrame:
    """The request's columns, id, and error: 'missing', 'ambiguous' (several rows of that key) or null."""
    counts = catalog.groupBy(F.col(catalog_key).alias("_k")).agg(F.count("*").alias("_n"), F.min(id_col).alias("_id"))
    out = requests.join(counts, F.col(key) == F.col("_k"), "left")
    error = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous")
    return out.select(*requests.columns, F.when(F.col("_n") == 1, F.col("_id")).alias("id"), error.alias("error"))


def ownership_errors(requests: DataFrame, catalog: DataFrame, company: int) -> DataFrame:
    """id and code ('missing', 'wrong_company', 'deprecated') of requested ids that may not be used. Rows without a company are shared."""
    joined = requests.select("id").distinct().join(catalog.select("id", "company_id", "active", F.lit(True).alias("_in")), "id", "left")
    code = F.when(F.col("_in").isNull(), "missing").when(F.col("company_id").isNotNull() & (F.col("company_id") != company), "wrong_company").when(~F.coalesce("active", F.lit(True)), "deprecated")
    return joined.select("id", code.alias("code")).where("code IS NOT NULL")


def choose_journal(journals: DataFrame, wanted: str, fallback: str = "general", explicit: Column | None = None) -> DataFrame:
    """Per company the journal asked for, else the first of type ``wanted``, else the first of ``fallback``."""
    preference = F.when(F.col("type") == wanted, 1).when(F.col("type") == fallback, 2)
    if explicit is not None:
        preference = F.when(F.col("id") == explicit, 0).otherwise(preference)
    return first_by(journals.withColumn("preference", preference).where("preference IS NOT NULL"), ["company_id"], "preference", "id")


def new_references(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose reference does not exist yet."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def counterparts(lines: DataFrame, bank_account: str, move: str = "move_id") -> DataFrame:
    """Pairs of a bank line and the other lines of its move, without the bank account and without empty lines."""
    bank = lines.where(F.expr(bank_account)).select(F.col(move), F.col("line_id").alias("bank_line_id"), F.col("account").alias("bank_account"))
    rest = lines.where(~F.expr(bank_account)).where("debit != 0 OR credit != 0").select(F.col(move), F.col("line_id").alias("other_line_id"), F.col("account").alias("other_account"), "debit", "credit")
    return bank.join(rest, move)


def moves_with_lines(moves: DataFrame, lines: DataFrame, move: str = "move_id") -> DataFrame:
    """Every move with its lines; a move without lines has one row with empty ones."""
    return moves.join(lines, move, "left")


def find_references(requests: DataFrame, moves: DataFrame, fields: list[str]) -> DataFrame:
    """ref and move id: first exact hits in any field; only refs without one look for moves that contain them, through an index of trigrams. Null refs find nothing."""
    each = F.explode(F.array(*[F.col(c) for c in fields]))
    asked = requests.select("ref").where("ref IS NOT NULL").distinct()
    exact = moves.select("id", each.alias("ref")).where("ref IS NOT NULL").join(asked.hint("merge"), "ref").select("ref", "id").distinct()  # Spark takes exploded moves for small and would broadcast them
    rest = asked.join(exact.select("ref").distinct().hint("merge"), "ref", "left_anti").withColumn("term", F.lower("ref"))
    text = moves.select("id", F.concat_ws("\n", *[F.col(c) for c in fields]).alias("_text"))
    loose = TextIndex.of(text, "id", ["_text"]).find(rest).hint("merge").join(rest, "term").select("ref", "id").distinct()
    return exact.withColumn("how", F.lit("exact")).unionByName(loose.withColumn("how", F.lit("contains")))


def split_by_presence(rows: DataFrame, present: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is in ``present``, and those whose key isn't."""
    keys = present.select(key).distinct()
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def round_robin(items: DataFrame, owner: str, item: str, per_owner: int = 3, most: int = 100) -> DataFrame:
    """Up to ``per_owner`` items of each owner, first ones of all owners before second ones, ``most`` overall (a sampling operator)."""
    ranked = top_by(items, [owner], per_owner, item)
    return ranked.orderBy("rank", owner, item).limit(most)


def confident(candidates: DataFrame, key: str, score: str, least: float = 0.85, margin: float = 0.15, tie: str = "id") -> DataFrame:
    """Each key's best candidate, its lead over the second one, and ``accepted`` (good enough, and far enough ahead)."""
    by = Window.partitionBy(key).orderBy(F.desc(score), tie)
    out = candidates.withColumns({"_n": F.row_number().over(by), "_next": F.lead(score).over(by)}).where("_n = 1")
    lead = F.round(F.col(score) - F.coalesce("_next", F.lit(0.0)), 6)
    return out.withColumn("lead", lead).withColumn("accepted", (F.col(score) >= least) & (F.col("lead") >= margin)).drop("_n", "_next")


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of both, the changes' latest of each key (by ``order``) in place of the current one."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return first_by(both, keys, F.desc("_new"), F.desc(order)).drop("_new")


def sync_counts(current: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """status (created, updated, unchanged, absent) and n, from comparing contents by key."""
    joined = current.select(F.col(key), F.col(content).alias("_a"), F.lit(True).alias("_x")).join(incoming.select(F.col(key), F.col(content).alias("_b"), F.lit(True).alias("_y")), key, "full")
    status = F.when(F.col("_x").isNull(), "created").when(F.col("_y").isNull(), "absent").when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("updated")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def differences(expected: DataFrame, actual: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and column of every value that was not read back as expected; 'row' for rows that only one side has."""
    a = expected.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_x"))
    b = actual.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_y"))
    joined = a.join(b, key, "full")
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    found = [F.when(both & ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns] + [F.when(~both, F.lit("row"))]
    return joined.select(key, F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("column"))


def for_tenant(rows: DataFrame, tenant: int, column: str = "organization_id") -> DataFrame:
    """Only one organisation's rows; the filter reaches the scan."""
    return rows.where(F.col(column) == tenant)


def domain(terms: list, column_of=F.col, sure: bool = False) -> Column:
    """A predicate from prefix notation: triples (field, operator, value), joined by 'and' unless '|', '&' or '!' stands before.

    Operators: =, !=, <, <=, >, >=, in, not in, like, ilike. An empty list holds for every row. With ``sure`` a term on a null is false, not unknown.
    """
    def leaf(term) -> Column:
        name, op, value = term
        c = column_of(name)
        if op in ("in", "not in"):
            hit = c.isin(list(value))
            return hit if op == "in" else ~hit
        if op in ("like", "ilike"):
            return getattr(c, op)(f"%{value}%")
        if value is None or value is False:
            return c.isNull() if op == "=" else c.isNotNull()
        return {"=": c == value, "!=": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]

    stack: list[Column] = []
    for term in reversed(terms):
        if term == "!":
            stack.append(~stack.pop())
        elif term in ("|", "&"):
            a, b = stack.pop(), stack.pop()
            stack.append(a | b if term == "|" else a & b)
        else:
            holds = leaf(tuple(term))
            stack.append(F.coalesce(holds, F.lit(False)) if sure else holds)
    return reduce(lambda a, b: a & b, reversed(stack), F.lit(True))


def scan(rows: DataFrame, terms: list, relations: dict[str, tuple[DataFrame, str]], columns: list[str] | None = None) -> DataFrame:
    """``rows`` for which prefix terms hold, in which ``field.name`` is a field of the row that ``field`` points to.

    ``relations``: by field, a table and its key; its own fields may point on by entries named ``field.other``. Only the related columns that terms name are read, and each path is
    joined once, from the outside in; as a key stands once in its table, rows are not multiplied. A term on a related field does not hold where nothing is related, its
    negation by '!' does. Related columns are not returned.
    """
    paths = sorted({t[0] for t in terms if isinstance(t, (tuple, list)) and "." in t[0]})
    needed: dict[str, set[str]] = {}
    for path in paths:
        parts = path.split(".")
        for k in range(1, len(parts)):
            needed.setdefault(".".join(parts[:k]), set()).add(parts[k])
    out = rows
    for prefix in sorted(needed, key=lambda p: p.count(".")):
        if prefix not in relations:
            raise ValueError(f"nothing is related by {prefix}")
        table, key = relations[prefix]
        if not needed[prefix] <= set(table.columns):
            raise ValueError(f"no field {sorted(needed[prefix] - set(table.columns))} behind {prefix}")
        there = f"_{prefix}:key"
        side = table.where(F.col(key).isNotNull()).select(F.col(key).alias(there), *[F.col(c).alias(f"_{prefix}.{c}") for c in sorted(needed[prefix])])
        own = F.col(f"`_{prefix}`") if "." in prefix else F.col(prefix)
        out = out.join(side, own == F.col(f"`{there}`"), "left").drop(there)

    def column_of(name: str) -> Column:
        return F.col(f"`_{name}`") if "." in name else F.col(name)

    # What does not hold for want of a related row is false, so that its negation is true.
    found = out.where(domain(terms, column_of, sure=bool(paths)))
    return found.select(*(columns or rows.columns))


def ledger_lines(lines: DataFrame, accounts: list[int], first: str, last: str, most: int = 10_000) -> DataFrame:
    """A bank's posted lines (id, move_id, account_id, date, debit, credit) from ``first`` to ``last``, the oldest ``most`` of them.

    Those of ``accounts``, if any of these has a line; else all. Without accounts, the line of each move with the greatest |debit - credit| (ties: the oldest).
    Whether an account has a line is asked once; the answer decides which scan is planned.
    """
    dated = lines.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    mine = dated.where(F.col("account_id").isin(accounts))
    if accounts and not mine.isEmpty():
        dated = mine
    rows = dated.orderBy("date", "id").limit(most)
    if accounts:
        return rows
    size = F.abs(F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0)))
    return first_by(rows.withColumn("_size", size), ["move_id"], F.desc("_size"), "date", "id").drop("_size")


def as_current(accounts: DataFrame) -> DataFrame:
    """id, company_ids, deprecated of accounts from an older (company_id, deprecated) or a newer source (company_ids, active)."""
    one = F.when(F.col("company_id").isNotNull(), F.array("company_id")).otherwise(F.array().cast("array<int>")) if "company_id" in accounts.columns else F.col("company_ids")
    gone = F.col("deprecated") if "deprecated" in accounts.columns else ~F.col("active")
    return accounts.select("id", one.alias("company_ids"), gone.alias("deprecated"))


def page(rows: DataFrame, offset: int, size: int, most: int, *order: Column | str) -> DataFrame:
    """One page of a list in an order: at least 1 and at most ``most`` rows."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(max(size, 1), most))


def union_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """The rows of all results, each key once."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key])


def run_audit(rows: DataFrame, run: str, amount: str) -> DataFrame:
    """One row for each run: rows, total, and 'success' if the total is positive, else 'failure'."""
    out = rows.groupBy(F.col(run).alias("run")).agg(F.count("*").alias("rows"), F.sum(amount).cast("decimal(28,2)").alias("total"))
    return out.withColumn("status", F.when(F.col("total") > 0, "success").otherwise("failure"))


def catalog_counts(catalogs: dict[str, DataFrame]) -> DataFrame:
    """catalog and n of every catalog."""
    return reduce(DataFrame.unionByName, [c.agg(F.count("*").alias("n")).select(F.lit(name).alias("catalog"), "n") for name, c in catalogs.items()])


def manifest(rows: DataFrame, part: str, key: str, text: str) -> DataFrame:
    """For each part of an export its rows, first and last key, and characters."""
    return rows.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.sum(F.length(F.coalesce(text, F.lit("")))).cast("long").alias("chars"))
