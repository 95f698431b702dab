"""Queries of statements laid out as word boxes, and of their dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import layout
from . import tables as t
from .queries import query

_ORDERS = "o AS (SELECT o_orderkey AS k, o_orderkey // 20 AS statement, o_orderkey % 20 AS n, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(20, 2)) AS v, o_orderpriority AS p FROM orders)"


def boxes(spark, d):
    """statement, page, x0, x1, top, text: twenty orders a statement, ten a page, with headers, details below, balances beside or above, and a summary before the last orders of every third one."""
    k, o = F.col("k"), t.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 20).alias("statement"), (F.col("o_orderkey") % 20).alias("n"), F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast("decimal(20,2)").alias("v"), F.col("o_orderpriority").alias("p"))
    y = F.lit(160.0) + (F.col("n") % 10) * 55
    amount, balance = F.format_number("v", 2), F.format_number(F.col("v") + k, 2)

    def word(x0, x1, top, text, when=F.lit(True)):
        return F.when(when, F.struct(F.lit(x0).cast("double").alias("x0"), F.lit(x1).cast("double").alias("x1"), top.cast("double").alias("top"), text.alias("text")))

    short, full = F.date_format("d", "M/d"), F.date_format("d", "d/M/yyyy")
    words = [
        word(545, 560, y + 2, short), word(562, 580, y + 1, F.lit("3/4"), k % 4 == 1), word(500, 530, y, F.concat(F.lit("Order"), k.cast("string"))), word(460, 497, y + 3, F.lit("paid")), word(380, 420, y + 1, F.col("p")),
        word(270, 340, y, amount, k % 2 == 0), word(170, 240, y, amount, k % 2 == 1), word(60, 140, y, balance, k % 3 == 0), word(60, 140, y - 12, balance, k % 3 == 1),
        word(400, 450, y + 15, F.concat(F.lit("value "), full), k % 5 < 3), word(400, 450, y + 15, F.lit("no value date"), k % 5 == 3), word(100, 140, y + 30, F.lit("  ")), word(60, 140, F.lit(60.0), F.lit("Balance")), word(270, 340, F.lit(60.5), F.lit("Debit")),
        word(400, 450, F.lit(800.0), F.lit("page end")), word(400, 480, y + 21, F.lit("Closing balance"), (F.col("statement") % 3 == 0) & (F.col("n") == 14)),
    ]
    # Orders, not their words, go to the page that they stand on; as many tasks as a shuffle has, however small orders are.
    o = o.withColumn("page", F.floor(F.col("n") / 10) + 1).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "statement", "page")
    return o.select("statement", "page", F.explode(F.array(*words)).alias("w")).where("w IS NOT NULL").select("statement", "page", "w.*").distinct()


@query(
    "s08_layout_statement",
    rf"""WITH {_ORDERS}, r AS (SELECT *, month(d) || '/' || day(d) AS short FROM o WHERE NOT (statement % 3 = 0 AND n > 14))
    SELECT statement, row_number() OVER (PARTITION BY statement ORDER BY n)::INT AS row_number, CASE WHEN k % 5 < 3 THEN strftime(d, '%Y-%m-%d') WHEN try_cast('2024-' || lpad(month(d)::VARCHAR, 2, '0') || '-' || lpad(day(d)::VARCHAR, 2, '0') AS DATE) IS NOT NULL THEN '2024-' || strftime(d, '%m-%d') END AS date, short AS display_date,
      CASE WHEN k % 4 = 1 THEN '3/4' ELSE '' END AS other_date, 'paid Order' || k || ' ' || p || CASE WHEN k % 5 < 3 THEN ' value ' || day(d) || '/' || month(d) || '/' || year(d) WHEN k % 5 = 3 THEN ' no value date' ELSE '' END AS description,
      CASE WHEN k % 2 = 0 THEN v::DOUBLE ELSE 0 END AS debit, CASE WHEN k % 2 = 1 THEN v::DOUBLE ELSE 0 END AS credit, CASE WHEN k % 3 < 2 THEN (v + k)::DOUBLE END AS balance, CASE WHEN k % 2 = 0 THEN -v::DOUBLE ELSE v::DOUBLE END AS amount FROM r""",
)
def s08(spark, d):
    """Orders read back from the places of their words."""
    return layout.statement_rows(boxes(spark, d))


@query(
    "f06_short_dates",
    """WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT k, CASE k % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN CASE WHEN day(d) > 9 THEN 2000 + 20 + k % 21 ELSE 2023 END || strftime(d, '-%m-%d') WHEN 2 THEN '20' || strftime(d, '%y-%m-%d') WHEN 3 THEN 'due' ELSE '2023-' || strftime(d, '%m-%d') END AS date
    FROM o WHERE NOT (month(d) = 2 AND day(d) = 29)""",
)
def f06(spark, d):
    """Month and day of every order, with a full date of another day and, in some, of this one beside it."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    near = F.date_format(F.date_add(day, 40), "d/M/yyyy")
    told = F.when(k % 6 == 0, F.date_format(day, "d/M/yyyy")).when(k % 6 == 1, F.concat((20 + k % 21).cast("string"), F.date_format(day, "/M/d"))).when(k % 6 == 2, F.date_format(day, "d/M/yy")).otherwise("")
    rows = t.table(spark, d, "orders").where(~((F.month(day) == 2) & (F.dayofmonth(day) == 29)))
    shown = F.when(k % 6 == 3, "due").otherwise(F.date_format(day, "M/d"))
    return rows.select(k.alias("k"), layout.short_date(shown, F.concat_ws(" ", F.lit("paid"), near, told), 2023).alias("date"))
