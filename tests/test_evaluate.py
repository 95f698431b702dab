"""Grids, measures, blockwise search, scans by path and texts of workbooks against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate, lookup, retrieval
from ledgerloom.sources import workbooks


def test_threshold_grid(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([None, 0.0, 0.2, 0.5, rng.random()]), rng.choice([True, False, None])) for _ in range(300)] + [("empty", None, True)]
    grid = [0.5, 0.2, 0.9, 0.2]
    got = {(r.task, r.threshold): (r.tp, r.fp, r.fn, r.f1) for r in evaluate.threshold_grid(spark.createDataFrame(rows, "task string, score double, truth boolean").repartition(3), grid).collect()}
    for task in ("a", "b", "empty"):
        for t in (0.2, 0.5, 0.9):
            mine = [(s is not None and s >= t, bool(y)) for k, s, y in rows if k == task]
            tp, fp, fn = (sum(g and y for g, y in mine), sum(g and not y for g, y in mine), sum(y and not g for g, y in mine))
            assert got[task, t] == (tp, fp, fn, round(2 * tp / (2 * tp + fp + fn), 6) if tp + fp + fn else 0)
    best = {r.task: r.threshold for r in evaluate.best_thresholds(evaluate.threshold_grid(spark.createDataFrame(rows, "task string, score double, truth boolean"), grid)).collect()}
    assert best["a"] == min((-got["a", t][3], t) for t in (0.2, 0.5, 0.9))[1] and best["empty"] == 0.2


def test_multi_metrics(spark):
    rows = [(["a"], ["a"], ["a", "b"]), (["a", "b"], ["b", "c"], ["c", "b", "a"]), ([], [], ["a"]), (None, ["a"], None), (["b"], [], ["a", "b"])]
    df = spark.createDataFrame(rows, "truth array<string>, guess array<string>, ranked array<string>")
    r = evaluate.multi_metrics(df, 3, ranked="ranked", k=2).first()
    sets = [(set(t or []), set(g or []), (k or [])[:2]) for t, g, k in rows]
    both, size = sum(len(t & g) for t, g, _ in sets), sum(len(t) + len(g) for t, g, _ in sets)
    assert r.n == 5 and r.micro_f1 == round(2 * both / size, 6)
    assert r.samples_f1 == pytest.approx(sum(2 * len(t & g) / (len(t) + len(g)) if t or g else 0 for t, g, _ in sets) / 5, abs=1e-6)
    assert r.hamming_loss == pytest.approx(sum(len(t ^ g) for t, g, _ in sets) / 15, abs=1e-6) and r.exact_match == 0.4
    assert r.recall_at_k == pytest.approx(sum(len(t & set(k)) / len(t) for t, _, k in sets if t) / 3, abs=1e-6)
    joint = spark.createDataFrame([("validation", 1, 1, ["a"], ["a", "a"]), ("test", 1, 2, ["a"], ["a"]), ("test", None, None, None, [])], "split string, x int, y int, s array<string>, t array<string>")
    found = evaluate.joint_exact_match(joint, {"one": ("x", "y"), "many": ("s", "t")})
    assert {r.split: r.joint_exact_match for r in found.collect()} == {"validation": 1.0, "test": 0.5}
    assert evaluate.gaps(found.withColumn("k", F.lit(1)), ["k"], "joint_exact_match").first().gap == 0.5


@pytest.mark.parametrize("blocks", [(2048, 16384), (3, 7)])
def test_nearest(spark, monkeypatch, blocks):
    monkeypatch.setattr(retrieval, "QUERIES", blocks[0])
    monkeypatch.setattr(retrieval, "ROWS", blocks[1])
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(40)] + [(50, None), (51, []), (52, [1.0]), (53, [0.0] * 4), (54, [None, 1.0, 0.0, 0.0]), (None, [1.0] * 4), (60, [0.5] * 4), (61, [0.5] * 4)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>").repartition(3)
    asked = df.where("row_id % 5 = 0 OR row_id IS NULL OR row_id > 49").withColumnRenamed("row_id", "query_id")

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return 0.0
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return max(0.0, sum(x * y for x, y in zip(a, b)) / norm) if norm else 0.0

    for least in (0.0, 0.3):
        got: dict = {}
        for r in retrieval.nearest(asked, df, 6, least).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.row_id, r.score))
        for q, v in rows:
            if q is None or not (q % 5 == 0 or q > 49):
                continue
            scored = sorted((-math.floor(cosine(v, w) * 10_000 + 0.5) / 10_000, i) for i, w in rows if i is not None and i != q)
            want = [(n + 1, i, -s) for n, (s, i) in enumerate([x for x in scored if -x[0] >= least][:6])]
            assert sorted(got.get(q, [])) == want
        assert None not in got


def test_scan_by_path(spark):
    lines = spark.createDataFrame([(1, 10, 5), (2, 11, 6), (3, None, 7), (4, 99, 8)], "id long, move_id long, v long").withColumn("_key", F.lit("clash"))
    moves = spark.createDataFrame([(10, "INV/1", 100), (11, None, 101), (12, "x", None)], "key long, ref string, partner long")
    partners = spark.createDataFrame([(100, "Acme"), (101, "Bolt")], "pid long, name string")
    related = {"move_id": (moves, "key"), "move_id.partner": (partners, "pid")}

    def ids(terms):
        return {r.id for r in lookup.scan(lines, terms, related, ["id"]).collect()}

    assert ids([("move_id.ref", "ilike", "inv")]) == {1}
    assert ids(["!", ("move_id.ref", "ilike", "inv")]) == {2, 3, 4}
    assert ids(["|", ("move_id.partner.name", "=", "Bolt"), ("v", ">", 7)]) == {2, 4}
    assert ids([("move_id.ref", "=", None), ("move_id", "!=", None)]) == {2, 4}
    assert lookup.scan(lines, [("v", ">", 5)], related).columns == lines.columns
    for bad in ("other.ref", "move_id.none", "move_id.partner.none"):
        with pytest.raises(ValueError):
            lookup.scan(lines, [(bad, "=", 1)], related)


def test_ledger_lines(spark):
    rows = [(1, 1, 5, "2024-01-02", 10.0, 0.0), (2, 1, 6, "2024-01-01", 0.0, 30.0), (3, 2, 5, "2024-01-03", None, 4.0), (4, 2, 7, "2024-01-03", 4.0, None), (5, 3, 7, "2025-01-01", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, move_id long, account_id long, date string, debit double, credit double").withColumn("date", F.to_date("date"))

    def ids(accounts, most=100):
        return [r.id for r in lookup.ledger_lines(df, accounts, "2024-01-01", "2024-12-31", most).orderBy("date", "id").collect()]

    assert ids([5]) == [1, 3] and ids([9]) == [2, 1, 3, 4] and ids([]) == [2, 3] and ids([], 2) == [2]


def test_workbooks(spark):
    rows = [("w", 1, "A", 0, ["x\r\ny", None, " z "]), ("w", 1, "A", 1, ["", None]), ("w", 2, "B", 0, []), ("w", 2, "B", 1, None), ("w", 3, "C", 5, ["a"]), ("w", 3, "C", 4, ["b", "c"]), (None, 1, "N", 0, ["n"]), ("big", 1, "A", 0, ["1", "2", "3", "4"]), ("big", 2, "A", 0, ["1" * 50])]
    df = spark.createDataFrame(rows, "workbook string, sheet_no int, sheet string, row_no int, values array<string>").withColumn("n", F.lit(9))
    got = {r.workbook: r for r in workbooks.workbook_texts(df, workbooks.SheetLimits(sheets=3, rows=2, columns=3, cells=9, chars=40)).collect()}
    assert got["w"].text == "[Sheet: A]\nx y\t\tz\n\n[Sheet: B]\n\n[Sheet: C]\nb\tc\na" and (got["w"].sheets, got["w"].cells) == (3, 8)
    assert got["big"].text is None and got["big"].exceeded == ["columns", "chars"] and got[None].text == "[Sheet: N]\nn"
    att = spark.createDataFrame([(k, k % 2, f"f{k}.{'exe' if k == 3 else 'PDF'}", 10) for k in range(8)] + [(20, None, "a.pdf", 1), (21, 1, "a.pdf", 1 << 40)], "id long, move_id long, name string, size long")
    assert [r.id for r in workbooks.chosen_attachments(att, per_move=2, most=3).collect()] == [0, 1, 2]
    read = spark.createDataFrame([(2, 1, "b", "extracted", "B"), (1, 1, "a", "extracted", "A"), (3, 1, "c", "extracted", ""), (4, 1, "d", "skipped_size", None), (5, 2, "e", "odd", None)], "id long, move_id long, name string, status string, text string")
    out, total = workbooks.enriched(spark.createDataFrame([(1, "t"), (2, "u"), (3, None)], "move_id long, text string"), read)
    assert {r.move_id: tuple(r)[1:] for r in out.collect()} == {1: ("t | attachment_content a A | attachment_content b B", 2, 0, 1, 1), 2: ("u", 0, 0, 0, 1), 3: (None, 0, 0, 0, 0)}
    assert tuple(total.first()) == (5, 2, 0, 1, 2)
