"""The engine's inputs derived from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LEDGER_SQL = """ledger AS (
  SELECT o_orderkey AS idx, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS description,
         CAST(CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * round(o_totalprice / 500) * 500 AS DECIMAL(20, 2)) AS amount
  FROM orders)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, date, description, amount: one row per order, amounts rounded so that some agree."""
    sign = F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(1)
    amount = (sign * F.round(F.col("o_totalprice") / 500) * 500).cast("decimal(20,2)")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("description"), amount.alias("amount"))


STATEMENT_SQL = """statement AS (
  SELECT idx + c * 1000000000 AS idx, CAST(date + CAST(idx % 11 - 2 AS INTEGER) AS DATE) AS date, description, amount
  FROM ledger, (VALUES (0), (1)) v(c) WHERE idx % 7 <> 0 AND (c = 0 OR idx % 50 = 0))"""


def statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger seen from the bank: six rows of seven, up to eight days off, one of fifty twice."""
    rows = ledger(spark, sf_dir).where("idx % 7 != 0")
    rows = rows.withColumn("date", F.expr("date_add(date, CAST(idx % 11 - 2 AS INT))"))
    copies = F.when(F.col("idx") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("_c", F.explode(copies)).withColumn("idx", F.col("idx") + F.col("_c") * F.lit(1_000_000_000)).select("idx", "date", "description", "amount")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, line_id, account, debit, credit: a debit per lineitem, and a credit of their sum (of too much for one order of ten)."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(20,2)").alias("v"), "l_suppkey")
    zero = F.lit(0).cast("decimal(20,2)")
    debit = items.select(F.col("l_orderkey").alias("entry_id"), F.col("l_linenumber").cast("long").alias("line_id"), (F.col("l_suppkey") % 10).alias("account"), F.col("v").alias("debit"), zero.alias("credit"))
    total = items.groupBy("l_orderkey").agg(F.sum("v").alias("v"))
    wrong = F.when(F.col("l_orderkey") % 10 == 0, 1).otherwise(0)
    credit = total.select(F.col("l_orderkey").alias("entry_id"), F.lit(0).cast("long").alias("line_id"), F.lit(100).cast("long").alias("account"), zero.alias("debit"), (F.col("v") + wrong).cast("decimal(20,2)").alias("credit"))
    return debit.unionByName(credit)


ORDER_LINES_SQL = """lines AS (
  SELECT l_orderkey AS entry_id, CAST(l_linenumber AS BIGINT) AS line_id, l_suppkey % 10 AS account, CAST(l_extendedprice AS DECIMAL(20, 2)) AS debit, CAST(0 AS DECIMAL(20, 2)) AS credit FROM lineitem
  UNION ALL
  SELECT l_orderkey, 0, 100, CAST(0 AS DECIMAL(20, 2)), CAST(sum(CAST(l_extendedprice AS DECIMAL(20, 2))) + CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS DECIMAL(20, 2)) FROM lineitem GROUP BY l_orderkey)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule_id, version_number, approval_status: made from line items, as a large table of rule versions."""
    status = F.when(F.col("l_returnflag") == "R", "approved").when(F.col("l_returnflag") == "A", "superseded").otherwise("draft")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rule_id"), F.col("l_linenumber").alias("version_number"), status.alias("approval_status"))


VERSIONS_SQL = """versions AS (
  SELECT l_orderkey AS rule_id, l_linenumber AS version_number,
         CASE l_returnflag WHEN 'R' THEN 'approved' WHEN 'A' THEN 'superseded' ELSE 'draft' END AS approval_status FROM lineitem)"""
