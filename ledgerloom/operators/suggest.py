"""Suggestions for bank movements: from strict rules, fuzzy rules, historical entries, vectors and near duplicates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import sequence_ratio
from ..functions.scores import AMOUNT_STEPS, smart_score
from ..functions.text import bank_text, movement_kind

MOST_RULES = 1000


@dataclass(frozen=True)
class ModelRule:
    """A reconciliation rule as an ERP keeps it. ``account_id``: of its only counterpart line, None if it has not exactly one."""

    rule_id: int
    account_id: int | None
    name: str = ""
    label: str = ""  # contains, not_contains, match_regex or empty
    label_value: str = ""
    amount: str = ""  # lower, greater, between or empty
    low: float | None = None
    high: float | None = None
    partners: tuple[int, ...] = ()


def _label(rule: ModelRule, texts: list[Column]) -> Column | None:
    """None if the rule has no label condition; unknown or half-filled conditions hold for nothing."""
    mode, value = rule.label.strip().lower(), rule.label_value.strip()
    if not mode and not value:
        return None
    lower = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]
    hits = {"contains": lambda t: t.contains(value.lower()), "not_contains": lambda t: ~t.contains(value.lower()), "match_regex": lambda t: t.rlike("(?i)" + value)}
    if mode not in hits or not value:
        return F.lit(False)
    out = F.lit(mode == "not_contains")
    for t in lower:
        out = out & hits[mode](t) if mode == "not_contains" else out | hits[mode](t)
    return out


def _amount(rule: ModelRule, amount: Column) -> Column | None:
    """Magnitudes; without a mode, bounds of zero are no condition."""
    size, mode = F.abs(amount.cast("double")), rule.amount.strip().lower()
    low, high = (None if v is None else abs(v) for v in (rule.low, rule.high))
    if not mode:
        low, high = low or None, high or None
        if low is None and high is None:
            return None
        return (size >= low if low is not None else F.lit(True)) & (size <= high if high is not None else F.lit(True))
    if mode == "lower":
        return size <= high if high is not None else F.lit(False)
    if mode == "greater":
        return size >= low if low is not None else F.lit(False)
    if mode == "between" and low is not None and high is not None:
        return size.between(min(low, high), max(low, high))
    return F.lit(False)


def strict_match(rows: DataFrame, rules: list[ModelRule], texts: list[str], amount: str = "amount", partner: str | None = None) -> DataFrame:
    """``rows`` with rule_id and account_id of the first rule, in the order given, of which all conditions hold.

    A rule needs exactly one counterpart line and at least one condition. Rules are few (an error beyond ``MOST_RULES``) and become
    one projection.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most")
    hits = []
    for r in rules:
        allowed = F.col(partner).isin(*r.partners) if partner and r.partners else F.lit(False) if r.partners else None
        given = [c for c in (_label(r, [F.col(t) for t in texts]), _amount(r, F.col(amount)), allowed) if c is not None]
        if r.account_id is None or not given:
            continue
        ok = F.lit(True)
        for c in given:
            ok = ok & F.coalesce(c, F.lit(False))
        hits.append(F.when(ok, F.struct(F.lit(r.rule_id).cast("long").alias("rule_id"), F.lit(r.account_id).cast("long").alias("account_id"))))
    none = F.lit(None).cast("struct<rule_id:long,account_id:long>")
    found = rows.withColumn("_hit", F.coalesce(*hits, none))
    return found.select(*rows.columns, F.col("_hit.rule_id").alias("rule_id"), F.col("_hit.account_id").alias("account_id"))


def text_similarity(a: Column, b: Column, digits: bool = True) -> Column:
    """Of two bank texts the better of the sequence ratio and the shared share of words over two letters (without pure numbers if asked)."""
    def words(t: Column) -> Column:
        kept = F.filter(F.split(t, " "), lambda w: (F.length(w) > 2) if digits else (F.length(w) > 2) & ~w.rlike(r"^\d+$"))
        return F.array_distinct(kept)

    x, y = words(a), words(b)
    either = F.size(F.array_union(x, y))
    shared = F.size(F.array_intersect(x, y)) / F.greatest(either, F.lit(1))
    return F.when((a == "") | (b == ""), 0.0).otherwise(F.greatest(sequence_ratio(a, b), shared))


def fuzzy_rule(rows: DataFrame, rules: DataFrame, key: str, text: str = "description", amount: str = "amount", least: float = 0.42) -> DataFrame:
    """key, rule_id, account_id, confidence: the rule of best .62 label + .18 kind + .20 amount, the first one of ties, for review only.

    ``rules`` (rule_id, account_id, rule_text, label_value, mode, low, high) are few: they are broadcast after a count. Distinct texts are compared with the rules once,
    whatever their amounts; a row gets the rules that its text can reach ``least`` with, and the amount decides among them in the row.
    """
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    some = rows.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct().withColumns({"_n": bank_text(F.col("_t")), "_k": movement_kind(F.col("_t"))})
    there = rules.select("rule_id", "account_id", "mode", "low", "high", bank_text(F.col("label_value")).alias("_label"), bank_text(F.col("rule_text")).alias("_r"), movement_kind(F.col("rule_text")).alias("_rk"))
    pairs = some.join(F.broadcast(there))
    contained = F.when((F.col("_label") != "") & F.col("_n").contains(F.col("_label")), 1.0).otherwise(0.0)
    kind = F.when((F.col("_k") != "general") & (F.col("_k") == F.col("_rk")), 1.0).otherwise(0.0)

    def confidence(said: Column, amount_score: Column) -> Column:
        return F.round(F.least(F.lit(1.0), said + amount_score * 0.20), 4)

    scored = pairs.withColumn("_s", F.greatest(text_similarity(F.col("_n"), F.col("_r")), contained) * 0.62 + kind * 0.18).where(confidence(F.col("_s"), F.lit(1.0)) >= least)
    of_text = scored.groupBy("_t").agg(F.collect_list(F.struct("rule_id", "account_id", "mode", F.abs("low").alias("low"), F.abs("high").alias("high"), "_s")).alias("_rules"))
    size = F.abs(F.col("_a").cast("double"))

    def ranked(r: Column) -> Column:
        low, high = r["low"], r["high"]
        inside = F.when(r["mode"] == "lower", size <= high).when(r["mode"] == "greater", size >= low).when(r["mode"] == "between", size.between(F.least(low, high), F.greatest(low, high)))
        amount_score = F.when(F.coalesce(r["mode"], F.lit("")) == "", 0.45).when(inside, 1.0).otherwise(0.0)
        return F.struct((-confidence(r["_s"], amount_score)).alias("c"), r["rule_id"].alias("rule_id"), r["account_id"].alias("account_id"))

    keyed = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("_u"), F.col(amount).alias("_a")).join(of_text, F.col("_u") == F.col("_t"))
    best = keyed.select(key, F.array_min(F.filter(F.transform("_rules", ranked), lambda b: -b["c"] >= least)).alias("_b")).where("_b IS NOT NULL")
    return best.select(key, "_b.rule_id", "_b.account_id", (-F.col("_b.c")).alias("confidence"))


def paired(left: DataFrame, right: DataFrame, block: int = 2000) -> DataFrame:
    """All pairs of a stated set (``left``) and what it is compared with, as an equi-join on blocks of about ``block`` rows of either side.

    Each row is copied to the blocks of its row or column of the grid; sizes are counted, nothing is broadcast, and any number of rows fits.
    """
    n, m = (max(1, -(-side.count() // block)) for side in (left, right))

    def dealt(side: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        return side.withColumn(own, F.pmod(F.xxhash64(*side.columns), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    return dealt(left, "_x", n, "_y", m).join(dealt(right, "_y", m, "_x", n), ["_x", "_y"]).drop("_x", "_y")


def historical_entry(rows: DataFrame, history: DataFrame, key: str, text: str = "description", amount: str = "amount", own: bool = False) -> DataFrame:
    """key, entry_id, account_id, confidence, needs_review: the past entry and counterpart of best .82 text + .12 amount + .06 kind; ties to the first.

    ``history``: entry_id, line_id, account_id, bank_text, line_text, bank_amount. ``rows`` is a stated set of movements of any size; with ``own`` an entry whose id is the movement's
    key is left out for it. Distinct texts are compared once, in blocks. Amounts count in steps: of each pair of texts that can win, the first entries of any amount and those of each
    step's range are looked up, so that movements and entries are not paired. Dates play no part.
    """
    asked = rows.select(F.col(key).alias("_key"), bank_text(F.col(text)).alias("_n"), movement_kind(F.col(text)).alias("_k"), F.col(amount).alias("_a"))
    size = F.abs(F.coalesce(F.col("bank_amount").cast("double"), F.lit(0.0))).alias("_size")
    there = history.where("account_id IS NOT NULL").select("entry_id", "line_id", "account_id", size, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("bank_text", "line_text")])
    of_bank = there.select("bank_text").distinct().select("bank_text", bank_text(F.col("bank_text")).alias("_b"), movement_kind(F.col("bank_text")).alias("_bk"))
    of_line = there.select("line_text").distinct().select("line_text", bank_text(F.col("line_text")).alias("_l"))
    there = there.join(of_bank, "bank_text").join(of_line, "line_text").drop("bank_text", "line_text")
    said = of_bank.select(F.col("_b").alias("_u")).union(of_line.select("_l")).distinct()
    like = paired(asked.select(F.col("_n").alias("_m")).distinct(), said)
    like = like.select("_m", "_u", text_similarity(F.col("_m"), F.col("_u"), False).alias("_s"))
    some = asked.select(F.col("_n").alias("_m"), "_k", "_a").distinct()

    # Of equal texts, kinds and amounts only the first entries can win: one, or two where the first may be the movement's own.
    most, said_by, entry = 2 if own else 1, ["_b", "_l", "_bk"], F.struct("entry_id", "line_id", "account_id")

    def firsts(of: list[str]) -> DataFrame:
        one = there.groupBy(*of, "entry_id").agg(F.min(entry).alias("_e"))
        return one.withColumn("_r", F.row_number().over(Window.partitionBy(*of).orderBy("_e"))).where(F.col("_r") <= most).select(*of, "_e", "_r")

    def confidence(amount_worth: Column) -> Column:
        return F.round(F.least(F.lit(1.0), F.col("_s") * 0.82 + amount_worth * 0.12 + F.col("_same") * 0.06), 4)

    any_amount = firsts(said_by)
    classes = any_amount.groupBy(*said_by).agg((F.max("_r") >= most).alias("_sure"))
    by_bank = classes.join(like.select("_m", F.col("_u").alias("_b"), F.col("_s").alias("_x")), "_b")
    both = by_bank.join(like.select("_m", F.col("_u").alias("_l"), F.col("_s").alias("_y")), ["_m", "_l"]).join(some.select("_m", "_k").distinct(), "_m")
    kind = F.when((F.col("_k") != "general") & (F.col("_k") == F.col("_bk")), 1.0).otherwise(0.0)
    scored = both.select("_m", "_k", *said_by, "_sure", F.greatest("_x", "_y").alias("_s"), kind.alias("_same"))
    # What a movement gets at least, whatever its amount: texts that stay below it with the best amount are out.
    least = F.max(F.when(F.col("_sure"), confidence(F.lit(0.0)))).over(Window.partitionBy("_m", "_k"))
    able = scored.withColumn("_least", least).where(confidence(F.lit(1.0)) >= F.coalesce("_least", F.lit(0.0))).drop("_least", "_sure")

    far = able.join(any_amount, said_by).select("_m", "_k", confidence(F.lit(0.0)).alias("confidence"), "_e").join(some, ["_m", "_k"])
    near = _within_steps(some.join(able, ["_m", "_k"]), firsts([*said_by, "_size"]).drop("_r"), said_by).withColumn("confidence", confidence(F.col("_worth")))
    of = ["_m", "_k", "_a"]
    every = far.select(*of, "confidence", "_e").unionByName(near.select(*of, "confidence", "_e"))
    once = every.groupBy(*of, "_e.entry_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "_e")).alias("_o"))
    top = once.withColumn("_r", F.row_number().over(Window.partitionBy(*of).orderBy("_o"))).where(F.col("_r") <= most)
    top = top.select("_m", F.col("_k").alias("_tk"), F.col("_a").alias("_ta"), "_o._e", (-F.col("_o.c")).alias("confidence"), "_r")
    same = F.col("_n").eqNullSafe(F.col("_m")) & F.col("_k").eqNullSafe(F.col("_tk")) & F.col("_a").eqNullSafe(F.col("_ta"))
    out = asked.join(top, same)
    if own:
        out = out.where(F.col("_key") != F.col("_e.entry_id"))
    chosen = out.groupBy("_key", "_n", "_k", "_a").agg(F.min_by(F.struct("_e", "confidence"), "_r").alias("_c"))
    return chosen.select(F.col("_key").alias(key), "_c._e.entry_id", "_c._e.account_id", "_c.confidence", (F.col("_c.confidence") < 0.60).alias("needs_review"))


def _within_steps(asked: DataFrame, entries: DataFrame, of: list[str]) -> DataFrame:
    """``asked`` (with _a and the columns ``of``) with _worth and _e: for each step of ``AMOUNT_STEPS`` the first two entries (_e) of the same ``of`` whose _size is in the step's range.

    Both sides are dealt to bands of sizes, a movement to its own and the two beside it; inside a band a table of firsts over the sorted sizes answers each range.
    """
    width = -math.log(AMOUNT_STEPS[-1][0]) * 1.001
    place = lambda size: F.floor(F.log(size) / width)
    mine = asked.withColumn("_size", F.abs(F.col("_a").cast("double"))).where("_size > 0")
    mine = mine.withColumn("_band", F.explode(F.sequence(place(F.col("_size")) - 1, place(F.col("_size")) + 1)))
    theirs = entries.where("_size > 0").select(*[F.col(c).alias(f"_their{c}") for c in of], place(F.col("_size")).alias("_their_band"), "_size", "_e.*")
    names = [f.name for f in entries.schema["_e"].dataType.fields]
    given = [c for c in asked.columns if c not in of]
    schema = T.StructType([*[asked.schema[c] for c in given], T.StructField("_worth", T.DoubleType()), *entries.schema["_e"].dataType.fields])

    def answers(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _first_in_ranges(right, names, left.column("_size").to_numpy()) if len(left) and len(right) else []
        parts = [left.select(given).take(pa.array(q)).append_column("_worth", pa.array(np.full(len(q), worth))) for q, _, worth in found]
        parts = [pa.Table.from_arrays([*part.columns, *right.select(names).take(pa.array(e)).columns], names=[*part.column_names, *names]) for part, (_, e, _) in zip(parts, found)]
        return pa.concat_tables(parts) if parts else to_arrow_schema(schema).empty_table()

    keys = [*of, "_band"]
    out = mine.groupBy(*keys).cogroup(theirs.groupBy(*[f"_their{c}" for c in keys])).applyInArrow(answers, schema)
    return out.select(*given, "_worth", F.struct(*names).alias("_e"))


def _first_in_ranges(entries: pa.Table, names: list[str], sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Row numbers of sizes and of the first and second entries (of different entry_id) in each step's range, with the step's worth."""
    n = len(entries)
    order = np.empty(n + 1, np.int64)  # row numbers by rank; rank n stands for no entry
    order[:n] = pc.sort_indices(entries, sort_keys=[(c, "ascending") for c in names], null_placement="at_start").to_numpy()
    rank = np.empty(n, np.int32)
    rank[order[:n]] = np.arange(n, dtype=np.int32)
    ids = np.full(n + 1, -2, np.int64)
    ids[:n] = pc.fill_null(pc.index_in(entries.column(names[0]), pc.unique(entries.column(names[0]))), -1).to_numpy()[order[:n]]
    by_size = np.argsort(entries.column("_size").to_numpy(), kind="stable")
    value, none = entries.column("_size").to_numpy()[by_size], np.int32(n)

    def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        first = np.minimum(a[0], b[0])
        rest = [np.where(ids[x] != ids[first], x, none) for x in (*a, *b)]
        return first, np.minimum.reduce(rest)

    tables = [(rank[by_size], np.full(n, none))]  # of 1, 2, 4 ... neighbours
    while 2 ** len(tables) <= n:
        half, (one, two) = 2 ** (len(tables) - 1), tables[-1]
        tables.append(merged((one[:-half], two[:-half]), (one[half:], two[half:])))

    def first_where(holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), n)
        while (low < high).any():
            middle = (low + high) // 2
            yes = holds(value[np.minimum(middle, n - 1)])
            low, high = np.where((low < high) & ~yes, middle + 1, low), np.where((low < high) & yes, middle, high)
        return low

    out = []
    for bound, worth in AMOUNT_STEPS:
        start = first_where(lambda v: (v >= sizes) | (v / sizes >= bound))  # noqa: B023
        end = first_where(lambda v: (v > sizes) & (sizes / v < bound))  # noqa: B023
        some = np.flatnonzero(start < end)
        power = np.floor(np.log2(end[some] - start[some])).astype(int)
        for p in np.unique(power):
            q = some[power == p]
            one, two = ((t[start[q]], t[end[q] - 2**p]) for t in tables[p])
            first, second = merged((one[0], two[0]), (one[1], two[1]))
            hit = np.r_[first, second]
            known = hit < n
            out.append((np.r_[q, q][known], order[hit[known]], worth))
    return out


def smart_matches(found: DataFrame, least: float = 0.6, per_query: int = 5) -> DataFrame:
    """s_idx, l_idx, confidence: statement rows in order take their best hit whose ledger row is still free.

    ``found``: s_idx, l_idx, s_amount, l_amount, vector (a score). Rows can only contend for a ledger row that they share, so each
    connected set of statement and ledger rows is walked on its own. With ``per_query`` hits a row, sets stay small.
    """
    hits = first_ranked(found, per_query).withColumn("score", F.round(smart_score(F.col("vector"), F.col("s_amount"), F.col("l_amount")), 4)).where(F.col("score") >= least)
    sets = connected(hits.select(F.col("s_idx").alias("a"), F.col("l_idx").alias("b")))
    rows = hits.join(sets, hits["s_idx"] == sets["a"]).select("set", "s_idx", "rank", "l_idx", "score")
    rows = rows.repartition("set").sortWithinPartitions("set", "s_idx", "rank")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, row, used = None, None, set()
        for pdf in batches:
            out = []
            for which, s, l, score in zip(pdf["set"], pdf["s_idx"], pdf["l_idx"], pdf["score"]):
                if which != last:
                    last, used = which, set()
                if s != row and l not in used:
                    row = s
                    used.add(l)
                    out.append((s, l, round(score, 2)))
            yield pd.DataFrame(out, columns=["s_idx", "l_idx", "confidence"])

    return rows.mapInPandas(walk, "s_idx long, l_idx long, confidence double")


def first_ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("s_idx").orderBy(F.desc("vector"), "l_idx")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def connected(links: DataFrame) -> DataFrame:
    """a and set: the least left end that a chain of links (a, b) leads to. Labels go back and forth until none changes."""
    spark = links.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    links = links.distinct().checkpoint()
    label = links.select("a", F.col("a").alias("set")).distinct().checkpoint()
    while True:
        right = links.join(label, "a").groupBy("b").agg(F.min("set").alias("set"))
        new = links.join(right, "b").groupBy("a").agg(F.min("set").alias("_n")).join(label, "a").select("a", "set", "_n").checkpoint()
        changed = new.where("_n < set").limit(1).count()
        label = new.select("a", F.least("set", "_n").alias("set"))
        if not changed:
            return label


def _tokens(text: Column) -> Column:
    """Characters with their number so far: the size of the common part of two such sets bounds what a sequence ratio can match."""
    chars = F.split(text, "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.concat(F.lpad(F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda d: d == c)).cast("string"), 4, "0"), c))


def near_duplicates(rows: DataFrame, key: str, text: str = "description", least: float = 0.92) -> DataFrame:
    """key, similarity: the best sequence ratio of ``least`` or more with another row's different text.

    Distinct texts only. A ratio of r needs r * (n + m) / 2 characters in common, so two texts share one of their first rarest
    numbered characters (a prefix filter, without loss), and lengths within r / (2 - r).
    """
    distinct = rows.select(F.col(text).alias("_t")).where("_t != ''").distinct().withColumns({"_n": F.length("_t"), "_g": _tokens(F.col("_t"))})
    shortest = F.ceil(F.col("_n") * (least / (2 - least)))
    need = F.ceil(F.lit(least) * (F.col("_n") + shortest) / 2)
    prefix = F.slice(F.sort_array("_g", False), F.lit(1), F.greatest((F.col("_n") - need + 1).cast("int"), F.lit(1)))
    each = distinct.select("_t", "_n", "_g", F.explode(prefix).alias("_p"))
    other = each.select(F.col("_t").alias("_u"), F.col("_n").alias("_m"), F.col("_g").alias("_h"), "_p")
    close = (F.col("_t") < F.col("_u")) & (F.least("_n", "_m") >= F.greatest("_n", "_m") * (least / (2 - least)))
    enough = F.size(F.array_intersect("_g", "_h")) >= F.lit(least) * (F.col("_n") + F.col("_m")) / 2
    pairs = each.join(other, "_p").where(close).where(enough).select("_t", "_u").distinct()
    both = pairs.withColumns({"_x": sequence_ratio(F.col("_t"), F.col("_u")), "_y": sequence_ratio(F.col("_u"), F.col("_t"))})
    best = both.select(F.explode(F.array(F.struct("_t", F.col("_x").alias("_r")), F.struct(F.col("_u").alias("_t"), F.col("_y").alias("_r")))).alias("_e")).select("_e.*")
    best = best.where(F.col("_r") >= least).groupBy("_t").agg(F.round(F.max("_r"), 3).alias("similarity"))
    return rows.select(key, F.col(text).alias("_t")).join(best, "_t").select(key, "similarity")


def exception_action(rows: DataFrame, category: Column, confidence: Column, duplicate: Column, side: Column) -> DataFrame:
    """``rows`` with action and confidence: a near duplicate, a missing line on the other side, or the category; weak ones need review."""
    copy = F.coalesce(duplicate, F.lit(0.0)) >= 0.92
    open_ = category == "needs_review"
    action = F.when(copy, "duplicate_possible").when((side == "ledger_only") & open_, "missing_bank_line").when((side == "bank_only") & open_, "missing_ledger_entry").otherwise(category)
    sure = F.when(copy, F.greatest(confidence, F.lit(0.72))).when((side == "ledger_only") & open_, 0.55).when((side == "bank_only") & open_, 0.52).otherwise(confidence)
    return rows.withColumns({"action": F.when(sure < 0.55, "needs_review").otherwise(action), "confidence": F.round(sure, 2)})


def best_candidates(votes: DataFrame, accounts: DataFrame, strength: Column, query: str = "query_id", limit: int = 5) -> DataFrame:
    """Of each query's first max(2 * limit, 10) votes (query, label, vote, lexical) the ``limit`` best by .92 * vote * strength + .08 * lexical; deprecated accounts go."""
    first = first_by_rank(votes, query, max(2 * limit, 10), F.desc("vote"), "label")
    known = first.join(accounts.select(F.col("id").alias("label"), "deprecated"), "label", "left").where("NOT coalesce(deprecated, false)")
    score = F.round(F.least(F.lit(0.995), F.col("vote") * strength * 0.92 + F.col("lexical") * 0.08), 4)
    out = known.withColumns({"confidence": score, "resolved": F.col("deprecated").isNotNull()})
    return first_by_rank(out, query, limit, F.desc("confidence"), F.desc("vote"), "label").select(query, "label", "confidence", "resolved", "rank")


def first_by_rank(rows: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def imported(rule: ModelRule) -> tuple[list[str], list[str]]:
    """An ERP rule's conditions in this engine's terms (field.operator=value), and what could not be taken over."""
    out, warnings = [], []
    operators = {"contains": "contains", "not_contains": "not_contains", "match_regex": "regex"}
    if rule.label_value.strip():
        if rule.label.strip().lower() in operators:
            out.append(f"statement_text.{operators[rule.label.strip().lower()]}={rule.label_value.strip()}")
        else:
            warnings.append("label operator")
    mode = rule.amount.strip().lower()
    made = {"lower": f"amount.lte={rule.high}", "greater": f"amount.gte={rule.low}", "between": f"amount.between={rule.low}..{rule.high}"}
    if mode in made:
        out.append(made[mode])
    elif mode:
        warnings.append("amount mode")
    if rule.partners:
        warnings.append("partners")
    return out, warnings
