"""Text of workbooks whose cells are rows of a table, within limits; and the text of attachments beside the entries they belong to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lookup import top_by

#: Attachments that have a text.
EXTENSIONS = (".pdf", ".xlsx", ".xls", ".csv", ".txt", ".docx", ".png", ".jpg", ".jpeg")


@dataclass(frozen=True)
class SheetLimits:
    """What a workbook may hold at most; characters count for each sheet."""

    sheets: int = 50
    rows: int = 50_000
    columns: int = 256
    cells: int = 500_000
    chars: int = 2_000_000


def workbook_texts(rows: DataFrame, limits: SheetLimits = SheetLimits()) -> DataFrame:
    """workbook, sheets, cells, exceeded (the limits that it breaks, in the order of ``SheetLimits``) and text of every workbook; no text for one that breaks a limit.

    ``rows``: workbook, sheet_no, sheet (its title), row_no, values (array of text). A sheet is ``[Sheet: title]`` and its rows, cells parted by tabs, without white space behind them and without empty rows;
    sheets are parted by an empty line. Line ends in cells are spaces, nulls are empty.

    Limits are sums: of rows by sheet and of sheets by workbook, so that no workbook is sorted before it is known to fit. Only workbooks within their limits are put together.
    """
    cell = F.transform("values", lambda v: F.trim(F.regexp_replace(F.coalesce(v, F.lit("")), "\r\n|\r|\n", " ")))
    lines = rows.select("workbook", "sheet_no", "sheet", "row_no", F.coalesce(F.size("values"), F.lit(0)).alias("n"), F.rtrim(F.array_join(cell, "\t"), F.lit(" \t")).alias("line"))
    title = F.concat(F.lit("[Sheet: "), F.coalesce("sheet", F.lit("")), F.lit("]"))
    size = F.when(F.col("line") != "", F.length("line") + 1).otherwise(0)
    sheet = lines.groupBy("workbook", "sheet_no").agg(F.min("sheet").alias("sheet"), F.count("*").alias("rows"), F.max("n").alias("columns"), F.sum("n").alias("cells"), F.sum(size).alias("_chars")).withColumn("chars", F.col("_chars") + F.length(title))
    book = sheet.groupBy("workbook").agg(F.count("*").alias("sheets"), *[F.max(c).alias(c) for c in ("rows", "columns", "chars")], F.sum("cells").alias("cells"))
    broken = F.filter(F.array(*[F.when(F.col(c) > getattr(limits, c), F.lit(c)) for c in ("sheets", "rows", "columns", "cells", "chars")]), lambda c: c.isNotNull())
    book = book.select("workbook", "sheets", "cells", broken.alias("exceeded"))
    fits = book.where(F.size("exceeded") == 0).select(F.col("workbook").alias("_book"))
    kept = lines.join(fits, F.col("workbook").eqNullSafe(F.col("_book"))).drop("_book")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line") != "", F.struct("row_no", "line")))), lambda x: x["line"]), "\n")
    sheets = kept.groupBy("workbook", "sheet_no").agg(F.min("sheet").alias("sheet"), body.alias("body"))
    section = F.when(F.col("body") == "", title).otherwise(F.concat(title, F.lit("\n"), "body"))
    whole = sheets.groupBy("workbook").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet_no", section.alias("text")))), lambda x: x["text"]), "\n\n").alias("text"))
    other = whole.select(F.col("workbook").alias("_book"), F.trim("text").alias("text"))
    return book.join(other, F.col("workbook").eqNullSafe(F.col("_book")), "left").drop("_book")


def chosen_attachments(attachments: DataFrame, most_bytes: int = 10 << 20, per_move: int = 3, most: int = 100) -> DataFrame:
    """``attachments`` (id, move_id, name, size) that are read, with ``rank``: of a known extension and size, the first ``per_move`` of each move, all first ones before second ones, ``most`` overall.

    The overall limit is the feature: a batch is bounded, and no entry uses it up.
    """
    extension = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    fit = attachments.where(F.col("move_id").isNotNull() & extension.isin(*EXTENSIONS) & (F.coalesce("size", F.lit(0)) <= most_bytes))
    return top_by(fit, ["move_id"], per_move, "id").orderBy("rank", "move_id", "id").limit(most)


def enriched(examples: DataFrame, read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``examples`` (move_id, text) with the texts of their attachments behind their own and the number of attachments by status; and one row of counts of all.

    ``read``: id, move_id, name, status (extracted, rejected, skipped..., no_text, else failed) and text. Texts stand in the order of ids, as ``attachment_content name text``.
    """
    status = F.when((F.col("status") == "extracted") & (F.coalesce("text", F.lit("")) != ""), "extracted").when(F.col("status") == "rejected", "rejected")
    status = status.when(F.col("status").startswith("skipped") | (F.col("status") == "no_text"), "skipped").otherwise("failed")
    rows = read.select("id", "move_id", status.alias("_s"), F.concat_ws(" ", F.lit("attachment_content"), "name", "text").alias("_t"))
    kinds = ("extracted", "rejected", "skipped", "failed")

    def counts() -> list:
        return [F.count(F.when(F.col("_s") == k, 1)).alias(k) for k in kinds]

    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_s") == "extracted", F.struct("id", "_t")))), lambda x: x["_t"]), " | ")
    by_move = rows.groupBy(F.col("move_id").alias("_m")).agg(said.alias("_said"), *counts())
    out = examples.join(by_move, F.col("move_id") == F.col("_m"), "left").fillna(0, list(kinds))
    longer = F.when(F.coalesce("_said", F.lit("")) != "", F.concat_ws(" | ", "text", "_said")).otherwise(F.col("text"))
    return out.withColumn("text", longer).drop("_m", "_said"), rows.agg(F.count("*").alias("requested"), *counts())
