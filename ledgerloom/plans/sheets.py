"""Queries of workbook texts and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import workbooks
from . import tables as t
from .queries import query

LIMITS = workbooks.SheetLimits(sheets=24, rows=45, columns=4, cells=2400, chars=1100)
_LINES = "i AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY ALL)"
_CELLS = _LINES + """, c AS (SELECT l_orderkey // 100 AS workbook, l_orderkey % 100 // 4 AS sheet_no, 'part ' || (l_orderkey % 100 // 4) AS sheet, l_orderkey % 4 * 10 + l_linenumber AS row_no,
  list_concat([l_returnflag, CASE WHEN l_linenumber % 3 > 0 THEN CAST(floor(l_quantity) AS INT)::VARCHAR END, l_linestatus], CASE WHEN l_orderkey % 1500 = 7 THEN ['x', 'y', ''] ELSE [CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END] END) AS v FROM i WHERE NOT (l_orderkey // 100 % 5 > 0 AND l_orderkey % 100 >= 96))"""


def _lines(spark, d):
    """One row for each order and line number."""
    return t.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")])


def _rows(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    last = F.when(k % 1500 == 7, F.array(F.lit("x"), F.lit("y"), F.lit(""))).otherwise(F.array(F.when(n % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd"))))
    cells = F.concat(F.array(F.col("l_returnflag"), F.when(n % 3 > 0, F.col("l_quantity").cast("int").cast("string")), F.col("l_linestatus")), last)
    sheet = F.floor(k % 100 / 4)
    rows = _lines(spark, d).where(~((F.floor(k / 100) % 5 > 0) & (k % 100 >= 96)))
    return rows.select(F.floor(k / 100).alias("workbook"), sheet.alias("sheet_no"), F.concat(F.lit("part "), sheet.cast("string")).alias("sheet"), (k % 4 * 10 + n).alias("row_no"), cells.alias("values"))


@query(
    "s12_workbook_text",
    f"""WITH {_CELLS}, l AS (SELECT *, len(v) AS n, regexp_replace(array_to_string([coalesce(x, '') FOR x IN v], chr(9)), '[ \\t]+$', '') AS line FROM c),
    s AS (SELECT workbook, sheet_no, min(sheet) AS sheet, count(*) AS rows, max(n) AS columns, sum(n)::BIGINT AS cells, length('[Sheet: ' || min(sheet) || ']') + sum(CASE WHEN line <> '' THEN length(line) + 1 ELSE 0 END) AS chars, string_agg(line, chr(10) ORDER BY row_no) FILTER (line <> '') AS body FROM l GROUP BY ALL),
    b AS (SELECT workbook, count(*) AS sheets, sum(cells)::BIGINT AS cells, max(rows) AS rows, max(columns) AS columns, max(chars) AS chars, string_agg('[Sheet: ' || sheet || ']' || coalesce(chr(10) || body, ''), chr(10) || chr(10) ORDER BY sheet_no) AS text FROM s GROUP BY workbook),
    e AS (SELECT *, concat_ws(',', CASE WHEN sheets > 24 THEN 'sheets' END, CASE WHEN rows > 45 THEN 'rows' END, CASE WHEN columns > 4 THEN 'columns' END, CASE WHEN cells > 2400 THEN 'cells' END, CASE WHEN chars > 1100 THEN 'chars' END) AS exceeded FROM b)
    SELECT workbook, sheets, cells, exceeded, CASE WHEN exceeded = '' THEN sha256(text) END AS text_sha256 FROM e""",
)
def s12(spark, d):
    """Orders as workbooks of four orders a sheet; some break a limit."""
    out = workbooks.workbook_texts(_rows(spark, d), LIMITS)
    return out.select("workbook", "sheets", "cells", F.array_join("exceeded", ",").alias("exceeded"), F.sha2("text", 256).alias("text_sha256"))


_ATTACHED = _LINES + """, a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS move_id, 'file' || l_linenumber || ['.PDF', '.xlsx', '.exe', '.txt'][l_partkey % 4 + 1] AS name, CAST(floor(l_quantity) AS INT) * 250000 AS size, ['extracted', 'rejected', 'skipped_size', 'no_text', 'timeout'][l_suppkey % 5 + 1] AS status, CASE WHEN l_suppkey % 7 > 0 THEN 'text ' || l_partkey END AS text FROM i),
f AS (SELECT *, row_number() OVER (PARTITION BY move_id ORDER BY id) AS rank FROM a WHERE NOT ends_with(name, '.exe') AND size <= 10485760 QUALIFY rank <= 3), r AS (SELECT * FROM f ORDER BY rank, move_id, id LIMIT 20000),
s AS (SELECT *, CASE WHEN status = 'extracted' AND text IS NOT NULL THEN 'extracted' WHEN status = 'rejected' THEN 'rejected' WHEN status IN ('skipped_size', 'no_text') THEN 'skipped' ELSE 'failed' END AS s FROM r)"""


def _attached(spark, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")

    def pick(values, by):
        return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))

    rows = _lines(spark, d).select(
        (k * 10 + n).alias("id"), k.alias("move_id"), F.concat(F.lit("file"), n.cast("string"), pick([".PDF", ".xlsx", ".exe", ".txt"], F.col("l_partkey"))).alias("name"), (F.col("l_quantity").cast("int") * 250_000).alias("size"),
        pick(["extracted", "rejected", "skipped_size", "no_text", "timeout"], F.col("l_suppkey")).alias("status"), F.when(F.col("l_suppkey") % 7 > 0, F.concat(F.lit("text "), F.col("l_partkey").cast("string"))).alias("text"),
    )
    examples = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("move_id"), F.col("o_orderpriority").alias("text"))
    return workbooks.enriched(examples, workbooks.chosen_attachments(rows, most=20_000))


@query(
    "m03_enriched_entries",
    f"""WITH {_ATTACHED}, m AS (SELECT move_id, string_agg('attachment_content ' || name || ' ' || text, ' | ' ORDER BY id) FILTER (s = 'extracted') AS said, count(*) FILTER (s = 'extracted') AS extracted, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed FROM s GROUP BY move_id)
    SELECT o_orderkey AS move_id, concat_ws(' | ', o_orderpriority, said) AS text, coalesce(extracted, 0) AS extracted, coalesce(rejected, 0) AS rejected, coalesce(skipped, 0) AS skipped, coalesce(failed, 0) AS failed FROM orders LEFT JOIN m ON move_id = o_orderkey""",
)
def m03(spark, d):
    """Entries with the texts of their attachments, three a move, in turns."""
    return _attached(spark, d)[0]


@query("m03_status_counts", f"WITH {_ATTACHED} SELECT count(*) AS requested, count(*) FILTER (s = 'extracted') AS extracted, count(*) FILTER (s = 'rejected') AS rejected, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'failed') AS failed FROM s")
def m03_counts(spark, d):
    return _attached(spark, d)[1]
