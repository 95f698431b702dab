"""Bank statements from the boxes of their words: lines by gaps, cells by bands, transactions by a walk over a statement's lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import digits_of, number_of, western_digits

# Where the centre of a word lies in its line, and the cell that it belongs to; further right it is description again.
BANDS = (("balance", 155), ("credit", 250), ("debit", 355), ("description", 540), ("dates", 595))
# Points by which words of a line may differ in height, a gap that parts words of a cell, and the part of a page that holds transactions.
TOLERANCE, GAP, TOP, BOTTOM = 4.5, 7, 140, 735
ARABIC = "[؀-ۿ]"


@dataclass(frozen=True)
class Words:
    """Words of lines that hold no transaction: two of ``header`` make a header, one of ``summary`` ends a statement."""

    header: tuple[str, ...] = ("date", "description", "debit", "credit", "balance", "التاريخ", "البيان", "مدين", "دائن", "الرصيد")
    summary: tuple[str, ...] = ("closing balance", "total debit", "total credit", "الرصيد الختامي", "إجمالي")


def lines_of(boxes: DataFrame) -> DataFrame:
    """statement, page, line, y and the cells balance, credit, debit, description and dates, from statement, page, x0, x1, top and text of every word.

    Words whose heights follow each other by ``TOLERANCE`` or less are one line. In a cell, words that stand closer than ``GAP`` are read together; the description, and any
    cell with Arabic letters, is read from the right, part by part. Words of white space do not count. Spark sorts the words of a page and numbers its lines; cells are put
    together in Arrow batches, with one line in hand where batches meet.
    """
    place = [F.col(c).cast("double").alias(c) for c in ("x0", "x1", "top")]
    words = boxes.select("statement", "page", *place, F.trim(western_digits(F.col("text"))).alias("text")).where("text <> ''").withColumn("x1", F.coalesce("x1", "x0"))
    order = ["top", "x0", "text"]
    down = Window.partitionBy("statement", "page").orderBy(*order)
    far = F.coalesce(F.col("top") - F.lag("top").over(down) > TOLERANCE, F.lit(True))
    words = words.withColumn("_new", far.cast("int")).withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("top", "y")
    head = words.select("statement", "page", "line", "y").schema
    schema = T.StructType([*head.fields, *[T.StructField(b, T.StringType()) for b, _ in BANDS]])
    # The window's order; Spark does not sort again for it.
    return words.sortWithinPartitions("statement", "page", "y", "x0", "text").mapInArrow(_whole_lines, schema)


def _whole_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("_new").to_numpy(zero_copy_only=False))
        if len(starts):
            yield from _cells([*held, batch.slice(0, starts[-1])])
            held = []
        held.append(batch.slice(starts[-1] if len(starts) else 0))
    yield from _cells(held)


def _sorted(cell: np.ndarray, numbers: list[np.ndarray], text: pa.Array) -> np.ndarray:
    """Places of the rows by cell, numbers (nulls first) and text; texts are looked at only where all else is equal."""
    keys = [cell, *[np.where(np.isnan(x), -np.inf, x) for x in numbers]]
    order = np.lexsort(keys[::-1])
    if np.all([k[order][1:] == k[order][:-1] for k in keys], axis=0).any():
        rank = np.empty(len(cell), int)
        rank[pc.sort_indices(text).to_numpy()] = np.arange(len(cell))
        order = np.lexsort([rank, *keys[::-1]])
    return order


def _joined(text: pa.Array, starts: np.ndarray) -> pa.Array:
    return text if len(starts) == len(text) else pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(text)), pa.int32()), text), " ")


def _cells(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line of some whole lines."""
    if not sum(b.num_rows for b in batches):
        return
    words = pa.Table.from_batches(batches).combine_chunks()
    text = words["text"].combine_chunks()
    x0, x1 = (words[c].to_numpy() for c in ("x0", "x1"))
    first = words["_new"].to_numpy() > 0
    lines = np.flatnonzero(first)
    band = np.searchsorted([end for _, end in BANDS], (x0 + x1) / 2, side="right")
    names = [b for b, _ in BANDS]
    description = names.index("description")
    cell = (np.cumsum(first) - 1) * len(BANDS) + np.where(band == len(BANDS), description, band)

    order = _sorted(cell, [x0, x1], text)
    cell, x0, x1, text = cell[order], x0[order], x1[order], text.take(pa.array(order))
    apart = np.ones(len(cell), bool)
    apart[1:] = (cell[1:] != cell[:-1]) | ~(x0[1:] - x1[:-1] <= GAP)
    starts = np.flatnonzero(apart)
    known = np.add.reduceat((~np.isnan(x0)).astype(float), starts)
    x = np.add.reduceat(np.where(np.isnan(x0), 0, x0), starts) / np.where(known, known, np.nan)
    cell, text = cell[starts], _joined(text, starts)

    order = _sorted(cell, [x], text)
    cell, text = cell[order], text.take(pa.array(order))
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    arabic = np.logical_or.reduceat(pc.match_substring_regex(text, ARABIC).to_numpy(zero_copy_only=False), starts)
    sizes = np.diff(np.append(starts, len(cell)))
    backwards = np.repeat(arabic | (cell[starts] % len(BANDS) == description), sizes)
    place = np.arange(len(cell))
    text = text.take(pa.array(np.where(backwards, np.repeat(2 * starts + sizes - 1, sizes) - place, place)))
    cell, text = cell[starts], _joined(text, starts)

    at = np.full(len(lines) * len(BANDS), -1)
    at[cell] = np.arange(len(cell))
    at = at.reshape(-1, len(BANDS))
    heads = [words[c].take(pa.array(lines)).combine_chunks() for c in ("statement", "page", "line", "y")]
    found = [pc.fill_null(text.take(pa.array(at[:, k], mask=at[:, k] < 0)), "") for k in range(len(BANDS))]
    yield pa.RecordBatch.from_arrays([*heads, *found], ["statement", "page", "line", "y", *names])


@dataclass
class Reader:
    """The transaction that is being read, and a balance that stood on a line of its own before it."""

    open: dict[str, Any] | None = None
    waiting: float | None = None
    stopped: bool = False
    done: list[dict[str, Any]] = field(default_factory=list)

    def close(self) -> None:
        if self.open:
            self.done.append(self.open)
        self.open = None

    def take(self, kind: str, dates: list[str], text: str, balance: float | None, credit: float | None, debit: float | None) -> None:
        """One line: of a summary, with dates, or neither."""
        if kind == "summary":
            self.close()
            self.stopped = True
        if self.stopped or kind != "line":
            return
        none = credit is None and debit is None
        if none and not dates and not text and balance is not None:
            self.waiting = balance
        elif dates and self.open and none and balance is None and not self.open["other_date"]:
            self.open["other_date"] = dates[0]  # the same day in another calendar
            self.open["details"] += [text] * bool(text)
        elif dates:
            self.close()
            self.open = {"display_date": dates[0], "other_date": dates[1] if len(dates) > 1 else "", "details": [text], "debit": debit, "credit": credit, "balance": self.waiting if balance is None else balance}
            self.waiting = None
        elif self.open:
            self.open["details"] += [text] * bool(text)
            self.open |= {k: v for k, v in (("debit", debit), ("credit", credit), ("balance", balance)) if self.open[k] is None}


def short_date(display: Column, text: Column, year: int = 2024) -> Column:
    """The date of a statement's line as ISO: month/day as shown, with the year that a full date of that day in the text tells (day/month/year, or two digits of a year from 20 to 40 before
    month/day), else ``year``; what is no month/day stays as it is."""
    month, day = (F.regexp_extract(display, r"^(\d{1,2})/(\d{1,2})", k).try_cast("int") for k in (1, 2))
    full = F.regexp_extract_all(F.concat_ws(" ", display, text), F.lit(r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b"), 1)

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date").cast("string")

    def told(date: Column) -> Column:
        a, b, c = (F.split(date, "/")[k].cast("int") for k in range(3))
        last = F.when((a == day) & (b == month), made(F.when(c < 100, 2000 + c).otherwise(c), b, a))
        first = F.when(a.between(20, 40) & (b == month) & (c == day), made(2000 + a, b, c))
        return F.coalesce(last, first)

    return F.coalesce(F.get(F.filter(F.transform(full, told), lambda x: x.isNotNull()), F.lit(0)), F.when(month.isNotNull(), made(F.lit(year), month, day)), display)


def statement_rows(boxes: DataFrame, words: Words = Words(), year: int = 2024) -> DataFrame:
    """statement, row_number, date, display_date, other_date, description, debit, credit, balance and amount (credit less debit) of every transaction.

    Lines outside the middle of a page, headers, and all from a summary on are left out. A line with a date begins a transaction; a balance on a line of its own is that of the next
    one; other lines add words and amounts that are still missing. Spark sorts the lines; a task walks a statement with one transaction in hand.
    """
    cells = ("balance", "credit", "debit")
    lines = lines_of(boxes).where(F.col("y").between(TOP, BOTTOM)).withColumn("_whole", F.lower(F.concat_ws(" ", *[b for b, _ in BANDS])))
    whole, summary = F.col("_whole"), F.lit(False)
    hits = sum((whole.contains(w).cast("int") for w in words.header), F.lit(0))
    for w in words.summary:
        summary = summary | whole.contains(w)
    kind = F.when(summary, "summary").when(hits >= 2, "header").otherwise("line")
    dates = F.array_join(F.regexp_extract_all("dates", F.lit(r"(\d{1,2}/\d{1,2}(?:/\d{2,4})?)"), 1), " ")
    cells = ("balance", "credit", "debit")
    # Each cell's text and its digits are made once. By array functions, so that the step's code stays small enough to be compiled.
    raw = F.transform(F.array(*cells), lambda c: F.when(c != "", F.trim(western_digits(c))))
    amounts = F.transform(F.transform(raw, lambda r: F.struct(r.alias("raw"), digits_of(r).alias("digits"))), lambda x: number_of(x["raw"], x["digits"]).cast("double"))
    rows = lines.select("statement", "page", "line", kind.alias("kind"), dates.alias("dates"), F.col("description").alias("text"), amounts.alias("_amounts"))
    rows = rows.select("*", *[F.col("_amounts")[k].alias(c) for k, c in enumerate(cells)]).drop("_amounts")
    key = dict(rows.dtypes)["statement"]
    schema = f"statement {key}, row_number int, display_date string, other_date string, told string, description string, debit double, credit double, balance double"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32(), *[pa.string()] * 4, *[pa.float64()] * 3]

    def rows_of(who: Any, reader: Reader, first: int) -> list[tuple]:
        out = []
        for n, t in enumerate(reader.done, first):
            told = t["details"]
            out.append((who, n, t["display_date"], t["other_date"], " ".join(told), " ".join(dict.fromkeys(x for x in told if x)).strip(" "), t["debit"], t["credit"], t["balance"]))
        return out

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [kind, *kinds])], names)

    def values(column: pa.Array) -> list:
        out = column.to_numpy(zero_copy_only=False).tolist()
        return [None if v != v else v for v in out] if pa.types.is_floating(column.type) else out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader, number, out, who_type = object(), Reader(), 1, [], pa.null()
        for batch in batches:
            who_type, coded = batch.column("statement").type, batch.column("statement").dictionary_encode("encode")
            whose = coded.dictionary.to_pylist()
            for k, kind, dates, *line in zip(values(coded.indices), *(values(batch.column(c)) for c in ("kind", "dates", "text", *cells))):
                who = whose[k]
                if who != last and not (who != who and last != last):  # NaN is one statement
                    reader.close()
                    out += rows_of(last, reader, number)
                    last, reader, number = who, Reader(), 1
                reader.take(kind, dates.split(), *line)
                if reader.done:
                    out += rows_of(last, reader, number)
                    number += len(reader.done)
                    reader.done = []
            yield table(out, who_type)
            out = []
        reader.close()
        if found := rows_of(last, reader, number):
            yield table(found, who_type)

    found = rows.repartition("statement").sortWithinPartitions("statement", "page", "line").mapInArrow(walk, schema)
    money = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("debit", "credit")}
    return found.select(
        "statement", "row_number", short_date(F.col("display_date"), F.col("told"), year).alias("date"), "display_date", "other_date", "description", *[v.alias(c) for c, v in money.items()], "balance",
        F.round(money["credit"] - money["debit"], 2).alias("amount"),
    )
