"""Statements from word boxes: lines, cells, and what carries over from line to line."""

import random

from pyspark.sql import functions as F

from ledgerloom.plans import layouts
from ledgerloom.sources import layout


def boxes(spark, rows):
    return spark.createDataFrame([(s, p, float(x), float(x + 10), float(y), text) for s, p, x, y, text in rows], "statement string, page int, x0 double, x1 double, top double, text string")


def test_lines_and_cells(spark):
    rows = [("a", 1, 100, 200, "1,000.00"), ("a", 1, 480, 203, "left"), ("a", 1, 500, 207, "right"), ("a", 1, 513, 207, "word"), ("a", 1, 560, 207.5, "1/2"), ("a", 1, 300, 213, "٥٠٫٢٥"), ("a", 1, 300, 230, " "), ("a", 2, 300, 213, "next"), (None, 1, 620, 300, "far")]
    got = {(r.statement, r.page, r.line): r for r in layout.lines_of(boxes(spark, rows)).collect()}
    assert set(got) == {("a", 1, 1), ("a", 1, 2), ("a", 2, 1), (None, 1, 1)}
    first = got["a", 1, 1]
    assert (first.y, first.balance, first.description, first.dates, first.credit) == (200.0, "1,000.00", "right word left", "1/2", "")
    assert got["a", 1, 2].debit == "50.25" and got[None, 1, 1].description == "far"


def test_lines_in_batches(spark, capsys):
    """Lines that lie in several Arrow batches, against a plain loop; words are sorted once, where each cell had a sort and groups of its own."""
    rng = random.Random(3)
    rows = [(s, p, rng.choice([None, *range(0, 600, 8)]), rng.choice([None, 6, 12]), rng.choice(range(0, 60, 3)), rng.choice(["a", "b", "كلمة", "٣", " "])) for s in ("x", None) for p in (1, 2) for _ in range(60)]
    rows = [(s, p, None if x is None else float(x), None if x is None or w is None else float(x + w), float(y), t) for s, p, x, w, y, t in rows]
    want, pages = {}, {}
    for s, p, x0, x1, y, t in rows:
        if t != " ":
            pages.setdefault((s, p), []).append((y, -1e9 if x0 is None else x0, x0 if x1 is None else x1, t.replace("٣", "3")))
    for page, words in pages.items():
        lines = []
        for w in sorted(words, key=lambda w: w[0]):
            if not lines or w[0] - lines[-1][-1][0] > layout.TOLERANCE:
                lines.append([])
            lines[-1].append(w)
        for n, line in enumerate(lines, 1):
            cells = {b: [] for b, _ in layout.BANDS}
            for _, x0, x1, t in line:
                cells[next((b for b, end in layout.BANDS if x0 > -1 and (x0 + x1) / 2 < end), "description")].append((x0, x1 if x1 is not None else -1e9, t))
            texts = []
            for b, words in cells.items():
                parts = []
                for w in sorted(words):
                    if not parts or w[0] < -1 or parts[-1][-1][1] < -1 or w[0] - parts[-1][-1][1] > layout.GAP:
                        parts.append([])
                    parts[-1].append(w)
                parts = sorted((sum(w[0] for w in part) / len(part), " ".join(w[2] for w in part)) for part in parts)
                texts.append(" ".join(t for _, t in (parts[::-1] if b == "description" or any("كلمة" in t for _, t in parts) else parts)))
            want[*page, n] = (line[0][0], *texts)
    frame = spark.createDataFrame(rows, "statement string, page int, x0 double, x1 double, top double, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {tuple(r[:3]): tuple(r[3:]) for r in layout.lines_of(frame).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    capsys.readouterr()
    layout.lines_of(frame).explain()
    plan = capsys.readouterr().out
    assert plan.count("Sort [") == 1 and plan.count("Exchange") == 1 and "collect_list" not in plan


def test_orders_are_dealt_before_words(spark, tmp_path, capsys):
    """Words of orders are made where their page is read; before, all of them were shuffled."""
    spark.sql("SELECT id AS o_orderkey, DATE'2024-01-05' AS o_orderdate, 10.5D AS o_totalprice, '1-URGENT' AS o_orderpriority FROM range(60)").write.parquet(f"{tmp_path}/orders.parquet")
    capsys.readouterr()
    layouts.boxes(spark, str(tmp_path)).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and plan.index("Generate explode") < plan.index("Exchange")
    assert layouts.boxes(spark, str(tmp_path)).where("page = 2 AND text LIKE 'Order%'").count() == 30


def test_statement(spark):
    rows = [
        ("s", 1, 60, 100, "9"), ("s", 1, 60, 150, "500.00"), ("s", 1, 560, 170, "2/3"), ("s", 1, 400, 170, "pay"), ("s", 1, 300, 170, "(10.50)"), ("s", 1, 400, 190, "on 3/2/2023"), ("s", 1, 560, 210, "7/8"), ("s", 1, 400, 210, "more"),
        ("s", 1, 170, 230, "4"), ("s", 1, 560, 250, "13/1"), ("s", 1, 400, 250, "odd"), ("s", 1, 60, 270, "600"), ("s", 2, 400, 160, "Total debit"), ("s", 2, 560, 200, "1/1"), ("t", 1, 400, 200, "no date"), ("t", 1, 560, 240, "12/31"),
    ]
    got = {(r.statement, r.row_number): r for r in layout.statement_rows(boxes(spark, rows), year=2022).collect()}
    assert set(got) == {("s", 1), ("s", 2), ("t", 1)}
    one = got["s", 1]
    assert (one.date, one.display_date, one.other_date, one.description) == ("2023-02-03", "2/3", "7/8", "pay on 3/2/2023 more")
    assert (one.debit, one.credit, one.balance, one.amount) == (-10.5, 4.0, 500.0, 14.5)
    assert (got["s", 2].date, got["s", 2].balance, got["s", 2].amount) == ("13/1", None, 0.0)
    assert (got["t", 1].date, got["t", 1].description) == ("2022-12-31", "")
    assert layout.statement_rows(boxes(spark, [])).collect() == []


def test_short_date(spark):
    cases = [("3/2", "paid 2/3/24", "2024-03-02"), ("3/2", "2/3/1999 2/3/24", "1999-03-02"), ("3/12", "29/3/12", "2029-03-12"), ("3/2", "3/2/24", "2020-03-02"), ("2/30", "30/2/2024", None), ("x", "2/3/24", "x"), (None, None, None)]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r.k: r.d for r in df.select("k", layout.short_date(F.col("a"), F.col("b"), 2020).alias("d")).collect()}
    for k, (a, _, want) in enumerate(cases):
        assert got[k] == (want if want is not None or a is None else a), cases[k]
