"""Registered queries of reviews, scopes, label sets and set checks, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup, review
from . import tables as t
from .queries import ORACLES, QUERIES, _COS, _found, query

__all__ = ["ORACLES", "QUERIES"]


@query("a14_label_sets", f"WITH {t.ORDER_LINES_SQL} SELECT entry_id, array_to_string(list_sort(list(DISTINCT account) FILTER (debit > 0)), ',') AS debits, array_to_string(list_sort(list(DISTINCT account) FILTER (credit > 0)), ',') AS credits, count(*) AS n_lines FROM lines GROUP BY entry_id")
def a14(spark, d):
    out = review.label_sets(t.order_lines(spark, d), "entry_id")
    return out.select("entry_id", F.array_join("debit_accounts", ",").alias("debits"), F.array_join("credit_accounts", ",").alias("credits"), "n_lines")


@query("a17_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def a17(spark, d):
    return t.table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(
    "a19_sheet_balance",
    """WITH c AS (SELECT l_orderkey AS sheet, CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(CAST(l_extendedprice AS DECIMAL(20, 2)) AS VARCHAR) END AS d, CASE WHEN l_orderkey % 2 = 0 AND l_linenumber = 3 THEN '-' WHEN l_orderkey % 2 = 1 AND l_linenumber = 1 THEN '0' ELSE CAST(CAST(l_extendedprice AS DECIMAL(20, 2)) AS VARCHAR) END AS c FROM lineitem),
    s AS (SELECT sheet, coalesce(sum(TRY_CAST(d AS DECIMAL(20, 2))), 0)::DECIMAL(28, 2) AS total_debit, coalesce(sum(TRY_CAST(c AS DECIMAL(20, 2))), 0)::DECIMAL(28, 2) AS total_credit FROM c GROUP BY sheet)
    SELECT *, abs(total_debit - total_credit) <= 0.01 AS balanced FROM s""",
)
def a19(spark, d):
    v, line, order = F.col("l_extendedprice").cast("decimal(20,2)").cast("string"), F.col("l_linenumber"), F.col("l_orderkey")
    credit = F.when((order % 2 == 0) & (line == 3), "-").when((order % 2 == 1) & (line == 1), "0").otherwise(v)
    cells = t.table(spark, d, "lineitem").select(order.alias("sheet"), F.when(line == 3, "n/a").otherwise(v).alias("d"), credit.alias("c"))
    return review.sheet_balance(cells, "sheet", "d", "c")


@query(
    "a11_multi_label_mean",
    f"WITH {_COS}, w AS (SELECT query_id, greatest(score, 1e-6) AS w, sum(greatest(score, 1e-6)) OVER (PARTITION BY query_id) AS total, list_distinct([label, label % 3]) AS ls FROM top), e AS (SELECT query_id, w, total, unnest(ls) AS label FROM w) SELECT query_id, label, round(sum(w) / max(total), 6) AS share FROM e GROUP BY ALL",
)
def a11(spark, d):
    found = _found(spark, d).withColumn("labels", F.array(F.col("label"), F.col("label") % 3))
    return review.multi_label_mean(found, "labels")


@query(
    "p25_review_states",
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pending_audit' WHEN 1 THEN 'needs_revision' WHEN 2 THEN 'awaiting_human_approval' ELSE 'approved' END AS state, CASE event_id % 5 WHEN 0 THEN 'errors' WHEN 1 THEN 'passed' WHEN 2 THEN 'resubmitted' WHEN 3 THEN 'approved' ELSE 'returned' END AS event FROM events)
    SELECT event_id, CASE WHEN state = 'pending_audit' AND event = 'errors' THEN 'needs_revision' WHEN state = 'pending_audit' AND event = 'passed' THEN 'awaiting_human_approval' WHEN state = 'needs_revision' AND event = 'resubmitted' THEN 'pending_audit' WHEN state = 'awaiting_human_approval' AND event = 'approved' THEN 'approved' WHEN state = 'awaiting_human_approval' AND event = 'returned' THEN 'needs_revision' END AS state FROM e""",
)
def p25(spark, d):
    state = F.element_at(F.array(*[F.lit(s) for s in ("pending_audit", "needs_revision", "awaiting_human_approval", "approved")]), (F.col("event_id") % 4 + 1).cast("int"))
    event = F.element_at(F.array(*[F.lit(s) for s in ("errors", "passed", "resubmitted", "approved", "returned")]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.table(spark, d, "events").select("event_id", review.next_state(state, event).alias("state"))


@query("p10_company_scope", "SELECT c_custkey, company_id FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey % 3 END AS company_id FROM customer) WHERE company_id IS NULL OR company_id = 1")
def p10(spark, d):
    rows = t.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey") % 3).alias("company_id"))
    return review.in_scope(rows, 1)


@query("p29_expiry", "SELECT event_id, CASE WHEN event_type <> 'signup' AND event_id % 600 >= 300 THEN 'expired' WHEN event_type <> 'signup' THEN 'pending' ELSE 'done' END AS status FROM events")
def p29(spark, d):
    e = t.table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "signup", "pending").otherwise("done").alias("status"), F.expr("ts + INTERVAL 300 SECONDS").alias("expires_at"), F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, CAST(event_id % 600 AS INT))").alias("now"))
    return review.expire(e, F.col("now")).select("event_id", "status")


@query("p30_journal_alias", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'bank' WHEN 1 THEN 'sale' WHEN 2 THEN 'purchase' ELSE 'general' END AS kind FROM orders")
def p30(spark, d):
    given = F.element_at(F.array(*[F.lit(s) for s in (" Bank ", "SALES", "bills", "misc")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return t.table(spark, d, "orders").select("o_orderkey", review.alias_of(given, {"bank": "bank", "sales": "sale", "bills": "purchase"}, "general").alias("kind"))


@query(
    "p22_prediction_gate",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS debit, l_discount * 10 AS journal FROM lineitem) SELECT l_orderkey, l_linenumber,
      concat_ws(',', CASE WHEN debit < 0.75 THEN 'debit' END, CASE WHEN journal < 0.65 THEN 'journal' END) AS blocked, debit >= 0.75 AND journal >= 0.65 AS allowed FROM s""",
)
def p22(spark, d):
    rows = t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("debit"), (F.col("l_discount") * 10).alias("journal"))
    return review.gate(rows, {"debit": 0.75, "journal": 0.65}).select("l_orderkey", "l_linenumber", "blocked", "allowed")


@query(
    "j18_closest_partner",
    """WITH n AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS a FROM part WHERE p_partkey % 100 = 0), p AS (SELECT p_partkey AS id, lower(p_type || ' ' || p_name) AS b FROM part),
    g AS (SELECT p_partkey, id, a, b, [substr(a, i, 2) FOR i IN range(1, length(a))] AS x, [substr(b, i, 2) FOR i IN range(1, length(b))] AS y FROM n, p),
    k AS (SELECT p_partkey, id, round(CASE WHEN a = b THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE 2.0 * coalesce(list_sum([least(len([h FOR h IN x IF h = q]), len([h FOR h IN y IF h = q])) FOR q IN list_distinct(x)]), 0) / (len(x) + len(y)) END, 6)::DOUBLE AS similarity FROM g)
    SELECT p_partkey, id AS partner_id, similarity FROM k WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY similarity DESC, id) = 1""",
)
def j18(spark, d):
    part = t.table(spark, d, "part")
    asked = part.where("p_partkey % 100 = 0").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    partners = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_type", "p_name").alias("partner"))
    return review.best_partner(asked, partners, "p_partkey", "name", "id", "partner", 0.5)


@query("u03_set_similarity", "SELECT p_partkey, len(list_intersect(a, b)) AS both_, len(list_distinct(list_concat(a, b))) AS either_ FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)")
def u03(spark, d):
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return t.table(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("both_"), F.size(F.array_union(a, b)).cast("long").alias("either_"))


@query(
    "s13_dotted_paths",
    """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0 LEFT JOIN nation ON n_nationkey = c_nationkey
    WHERE (coalesce(o_orderpriority ILIKE '%urgent%', false) OR coalesce(n_name IN ('FRANCE', 'CHINA'), false)) AND NOT coalesce(c_mktsegment = 'BUILDING', false) AND l_extendedprice >= 20000""",
)
def s13_paths(spark, d):
    """Line items by fields of their order, its customer and their nation; a third of the customers is unknown."""
    orders, customers = t.table(spark, d, "orders"), t.table(spark, d, "customer").where("c_custkey % 3 > 0")
    relations = {"l_orderkey": (orders, "o_orderkey"), "l_orderkey.o_custkey": (customers, "c_custkey"), "l_orderkey.o_custkey.c_nationkey": (t.table(spark, d, "nation"), "n_nationkey")}
    terms = ["|", ("l_orderkey.o_orderpriority", "ilike", "urgent"), ("l_orderkey.o_custkey.c_nationkey.n_name", "in", ["FRANCE", "CHINA"]), "!", ("l_orderkey.o_custkey.c_mktsegment", "=", "BUILDING"), ("l_extendedprice", ">=", 20000)]
    return lookup.scan(t.table(spark, d, "lineitem"), terms, relations, ["l_orderkey", "l_linenumber", "l_extendedprice"])


_BANK = """b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS move_id, l_suppkey % 100 AS account_id, CAST(l_shipdate AS DATE) AS date, CAST(CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice ELSE 0 END AS DECIMAL(20, 2)) AS debit,
  CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE 0 END AS DECIMAL(20, 2)) AS credit FROM lineitem WHERE l_linestatus = 'F' AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31')"""


def _bank_lines(spark, d):
    n, v, none = F.col("l_linenumber"), F.col("l_extendedprice"), F.lit(0)
    money = "decimal(20,2)"
    return t.table(spark, d, "lineitem").where("l_linestatus = 'F'").select(
        (F.col("l_orderkey") * 10 + n).alias("id"), F.col("l_orderkey").alias("move_id"), (F.col("l_suppkey") % 100).alias("account_id"), F.col("l_shipdate").cast("date").alias("date"),
        F.when(n % 2 == 1, v).otherwise(none).cast(money).alias("debit"), F.when(n % 2 == 0, v).otherwise(none).cast(money).alias("credit"),
    )


@query("s15_ledger_by_account", f"WITH {_BANK} SELECT id, account_id, date FROM b WHERE account_id IN (3, 7, 400) ORDER BY date, id LIMIT 10000")
def s15_account(spark, d):
    """Posted lines of a year, of the accounts asked for."""
    return lookup.ledger_lines(_bank_lines(spark, d), [3, 7, 400], "1996-01-01", "1996-12-31").select("id", "account_id", "date")


@query("s15_ledger_fallback", f"WITH {_BANK} SELECT id, account_id, date FROM b ORDER BY date, id LIMIT 10000")
def s15_fallback(spark, d):
    """No account asked for has a line: all lines are read."""
    return lookup.ledger_lines(_bank_lines(spark, d), [400, 401], "1996-01-01", "1996-12-31").select("id", "account_id", "date")


@query("s15_largest_lines", f"WITH {_BANK} SELECT move_id, id, debit, credit FROM (SELECT * FROM b ORDER BY date, id LIMIT 10000) QUALIFY row_number() OVER (PARTITION BY move_id ORDER BY abs(debit - credit) DESC, date, id) = 1")
def s15_largest(spark, d):
    """Without accounts: the largest line of each move."""
    return lookup.ledger_lines(_bank_lines(spark, d), [], "1996-01-01", "1996-12-31").select("move_id", "id", "debit", "credit")
