"""Bank statement files as transactions.

A file is a row (path, text); ``read_files`` makes them from any store that Spark reads. Formats become rows of cells
(path, row, cells) or transactions at once. What can't be read is missing from the result; ``require`` raises for files that
gave no row or have an unknown extension.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.money import parse_number, western_digits
from ..functions.text import normalize_date

# Words in a header cell that tell what its column holds.
HEADER_WORDS = {
    "date": ["date", "تاريخ"],
    "description": ["description", "الوصف", "البيان", "details", "وصف"],
    "amount": ["amount", "المبلغ", "مبلغ"],
    "debit": ["debit", "مدين", "withdrawal", "سحب", "خصم"],
    "credit": ["credit", "دائن", "deposit", "إيداع", "ايداع"],
    "balance": ["balance", "الرصيد"],
}
ENCODINGS = ("utf-8-sig", "utf-8", "cp1256", "cp1252", "iso-8859-1")
HEADER_ROWS = 30
TEXT_KINDS = ("csv", "tsv", "txt", "mt940", "sta")
KINDS = (*TEXT_KINDS, "ofx", "qfx", "qif")


def decode(content: bytes) -> str:
    """The first encoding of the ladder that fits."""
    for encoding in ENCODINGS:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def _by_ladder(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else decode(bytes(c)))


def decoded(content: Column) -> Column:
    """Bytes as text by the ladder of encodings; only what is no UTF-8 leaves the JVM. Python gets every row whatever branch it is in, so that the others go there as nulls."""
    plain = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2147483647)).otherwise(content)
    valid = F.is_valid_utf8(plain.cast("string"))
    return F.when(valid, plain.cast("string")).otherwise(_by_ladder(F.when(F.coalesce(valid, F.lit(False)), F.lit(None)).otherwise(content)))


# The first bytes (hexadecimal) of file types.
MAGIC = {"255044462D": "pdf", "504B0304": "zip", "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "D0CF11E0A1B11AE1": "ole"}


def file_type(content: Column) -> Column:
    """By the first bytes; 'text' if nine of ten of the first 512 are printable and none is zero; else 'unknown'."""
    start = F.hex(F.substring(content, 1, 512))
    odd = F.regexp_count(F.regexp_replace(start, "(..)", "$1 "), F.lit(r"(?:0[0-8BCEF]|1[0-9A-F]|7F) "))
    size = F.length(start) / 2
    out = F.when(size == 0, "unknown")
    for magic, name in MAGIC.items():
        out = out.when(start.startswith(magic), name)
    zero = F.regexp_replace(start, "(..)", "$1 ").contains("00 ")
    return out.when(~zero & (odd <= size * 0.1), "text").otherwise("unknown")


def kind_of(path: Column) -> Column:
    """Lower-case extension of a path."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def json_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (column value); lines that are no JSON object are left out."""
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("_r"), "value").where(F.get_json_object("value", "$").isNotNull())
    return parsed.select("_r.*")


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, kind (lower-case extension) and text of each file; a file is read whole by one task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "text": [decode(bytes(c)) for c in pdf["content"]]})

    files = spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, "path string, text string")
    return files.select("path", kind_of(F.col("path")).alias("kind"), "text")


def text_rows(files: DataFrame) -> DataFrame:
    """path, row (from 1), cells: each line is cut at tabs, bars, semicolons, commas (if two or more) or runs of spaces, whichever comes first in this order."""
    line = files.select("path", F.posexplode(F.split(F.col("text"), r"\r\n|\n|\r")).alias("_n", "_raw"))
    line = line.withColumn("_l", F.trim(western_digits(F.col("_raw")))).where("_l != ''")

    def cut(pattern: str) -> Column:
        return F.transform(F.split("_l", pattern), lambda c: F.trim(c))

    # Commas inside double quotes belong to the cell.
    quoted = F.transform(F.split("_l", r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))
    commas = F.length("_l") - F.length(F.replace("_l", F.lit(","), F.lit("")))
    cells = (
        F.when(F.col("_raw").contains("\t") & F.col("_l").contains("\t"), cut("\t"))
        .when(F.col("_l").contains("|"), cut(r"\|"))
        .when(F.col("_l").contains(";"), cut(";"))
        .when(commas >= 2, quoted)
        .otherwise(F.filter(cut(r"\s{2,}"), lambda c: c != ""))
    )
    return line.select("path", (F.col("_n") + 1).alias("row"), F.when(F.size(cells) > 0, cells).otherwise(F.array("_l")).alias("cells"))


def column_of(cells: Column, kind: str) -> Column:
    """Number (from 0) of the first cell that names ``kind``; -1 if none does."""
    def named(c: Column) -> Column:
        norm, hit = F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(False)
        for word in HEADER_WORDS[kind]:
            hit = hit | norm.contains(word)
        return hit

    return F.coalesce(F.array_position(F.transform(cells, named), True), F.lit(0)).cast("int") - 1


def headers(rows: DataFrame) -> DataFrame:
    """path, header_row and the column numbers of each file: of the first 30 rows the first with four points, else the best one.

    Two points for a date column, two for an amount, debit or credit column, one for a description.
    """
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("row"))).where(F.col("_k") <= HEADER_ROWS)
    first = first.withColumns({f"c_{k}": column_of(F.col("cells"), k) for k in HEADER_WORDS})
    money = (F.col("c_amount") >= 0) | (F.col("c_debit") >= 0) | (F.col("c_credit") >= 0)
    score = F.when(F.col("c_date") >= 0, 2).otherwise(0) + F.when(money, 2).otherwise(0) + F.when(F.col("c_description") >= 0, 1).otherwise(0)
    best = Window.partitionBy("path").orderBy(F.desc(F.col("_s") >= 4), F.when(F.col("_s") >= 4, F.col("row")), F.desc("_s"), "row")
    ranked = first.withColumn("_s", score).withColumn("_b", F.row_number().over(best)).where("_b = 1")
    return ranked.select("path", F.col("row").alias("header_row"), *[f"c_{k}" for k in HEADER_WORDS])


def transactions(rows: DataFrame) -> DataFrame:
    """path, row_number, date, description, amount, debit, credit, balance from rows of cells.

    The amount is credit less debit where either column has one, else the amount column. Rows without a date, an amount other
    than zero, or a description (other cells stand in for an empty one) give nothing.
    """
    head = headers(rows).where("c_date >= 0 AND (c_amount >= 0 OR c_debit >= 0 OR c_credit >= 0)")
    data = rows.join(head, "path").where("row > header_row")
    data = data.withColumn("row_number", F.row_number().over(Window.partitionBy("path").orderBy("row")))

    def cell(kind: str) -> Column:
        return F.when(F.col(f"c_{kind}") >= 0, F.trim(F.get("cells", F.col(f"c_{kind}"))))

    debit, credit = parse_number(cell("debit")), parse_number(cell("credit"))
    zero = F.lit(0).cast("decimal(20,2)")
    amount = F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(credit, zero) - F.coalesce(debit, zero)).otherwise(parse_number(cell("amount"))).cast("decimal(20,2)")
    skip = F.array(*[F.col(f"c_{k}") for k in ("date", "amount", "debit", "credit", "balance")])
    others = F.array_join(F.filter(F.transform("cells", lambda c, i: F.when(~F.array_contains(skip, i), F.trim(c))), lambda c: c.isNotNull() & (c != "")), " ")
    named = F.coalesce(cell("description"), F.lit(""))
    out = data.select(
        "path", "row_number", normalize_date(cell("date")).alias("date"), F.when(named != "", named).otherwise(others).alias("description"), amount.alias("amount"), parse_number(cell("balance")).alias("balance")
    )
    return _sided(out.where("date != '' AND description != '' AND amount IS NOT NULL AND amount != 0"))


def _sided(rows: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(20,2)")
    debit = F.when(F.col("amount") < 0, -F.col("amount")).otherwise(zero).cast("decimal(20,2)")
    credit = F.when(F.col("amount") > 0, F.col("amount")).otherwise(zero).cast("decimal(20,2)")
    if "balance" not in rows.columns:
        rows = rows.withColumn("balance", F.lit(None).cast("decimal(20,2)"))
    return rows.select("path", "row_number", "date", "description", "amount", debit.alias("debit"), credit.alias("credit"), "balance")


def ofx(files: DataFrame) -> DataFrame:
    """Transactions of OFX and QFX texts: a block from each STMTTRN tag to the next one or the end of the list."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?is)<STMTTRN>(.*?)(?=<STMTTRN>|</BANKTRANLIST>|\z)"), 1)
    block = files.select("path", F.posexplode(blocks).alias("_n", "_b"))

    def tag(name: str) -> Column:
        return F.trim(F.regexp_extract("_b", rf"(?i)<{name}>([^\r\n<]+)", 1))

    date = F.when(tag("DTPOSTED") != "", tag("DTPOSTED")).otherwise(tag("DTUSER"))
    # Such a date is followed by its time; its first eight digits are the day.
    date = F.when(date.rlike(r"^\d{8}"), F.substring(date, 1, 8)).otherwise(date)
    text = F.array_join(F.filter(F.array(*[tag(t) for t in ("NAME", "MEMO", "CHECKNUM", "FITID")]), lambda p: p != ""), " ")
    rows = block.select("path", (F.col("_n") + 1).alias("row_number"), normalize_date(date).alias("date"), text.alias("description"), parse_number(tag("TRNAMT")).alias("amount"))
    return _sided(rows.where("date != '' AND description != '' AND amount IS NOT NULL AND amount != 0"))


def qif(files: DataFrame) -> DataFrame:
    """Transactions of QIF texts; row_number is the line of the record's ``^`` (one past the last line for an unfinished record)."""
    parts = files.select("path", F.split("text", r"\r\n|\n|\r").alias("_parts"))
    # Counted once a file, before its lines are rows; the empty part behind a line break at the end is no line.
    after = (F.size("_parts") > 1) & (F.element_at("_parts", -1) == "")
    counted = parts.select("path", "_parts", (F.size("_parts") - after.cast("int")).alias("_all"))
    line = counted.select("path", "_all", F.posexplode("_parts").alias("_n", "_l"))
    line = line.withColumns({"_l": F.trim("_l"), "_n": F.col("_n") + 1}).where("_l != '' AND NOT startswith(_l, '!')")
    end = F.min(F.when(F.col("_l") == "^", F.col("_n"))).over(Window.partitionBy("path").orderBy(F.desc("_n")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    line = line.withColumn("_end", F.coalesce(end, F.col("_all") + 1)).where("_l != '^'")
    key = F.substring("_l", 1, 1)

    def last(k: str) -> Column:
        return F.coalesce(F.trim(F.max_by(F.when(key == k, F.expr("substring(_l, 2)")), F.when(key == k, F.col("_n")))), F.lit(""))

    record = line.groupBy("path", "_end").agg(*[last(k).alias(k) for k in "DTPM"])
    text = F.array_join(F.filter(F.array("P", "M"), lambda p: p != ""), " ")
    rows = record.select("path", F.col("_end").alias("row_number"), normalize_date(F.col("D")).alias("date"), text.alias("description"), parse_number(F.col("T")).alias("amount"))
    return _sided(rows.where("date != '' AND description != '' AND amount IS NOT NULL AND amount != 0"))


def parse(files: DataFrame) -> DataFrame:
    """Transactions of files of all known kinds."""
    out = transactions(text_rows(files.where(F.col("kind").isin(*TEXT_KINDS))))
    return out.unionByName(ofx(files.where("kind IN ('ofx', 'qfx')"))).unionByName(qif(files.where("kind = 'qif'")))


def require(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """``parsed``, after a check that every file has a known kind and gave a row; raises with the first ten that don't."""
    bad = files.select("path", "kind").join(parsed.select("path").distinct(), "path", "left_anti").limit(10).collect()
    if bad:
        raise ValueError("no transactions in " + ", ".join(f"{r.path} ({'empty' if r.kind in KINDS else 'unknown kind'})" for r in bad))
    return parsed


def as_grid(rows: DataFrame) -> DataFrame:
    """Transactions as flat texts for a sheet: date, description, debit, credit, balance; zero sides are empty."""
    def side(c: str) -> Column:
        return F.when(F.col(c) != 0, F.col(c).cast("string")).otherwise("")

    return rows.select("path", "row_number", "date", "description", side("debit").alias("debit"), side("credit").alias("credit"), F.coalesce(F.col("balance").cast("string"), F.lit("")).alias("balance"))
