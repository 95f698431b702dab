"""The review operators on small tables with nulls, ties and empty inputs."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import scores
from ledgerloom.operators import lookup, review


def test_next_state(spark):
    rows = spark.createDataFrame([("pending_audit", "errors"), ("approved", "errors"), (None, "passed"), ("awaiting_human_approval", "approved")], "s string, e string")
    assert [r.x for r in rows.select(review.next_state(F.col("s"), F.col("e")).alias("x")).collect()] == ["needs_revision", None, None, "approved"]


def test_in_scope_keeps_shared_rows(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 6)], "id long, company_id long")
    assert sorted(r.id for r in review.in_scope(rows, 5).collect()) == [1, 2]


def test_expire(spark):
    rows = spark.createDataFrame([(1, "pending", 10), (2, "pending", 11), (3, "done", 1), (4, "pending", None)], "id long, status string, expires_at long")
    assert {r.id: r.status for r in review.expire(rows, F.lit(10)).collect()} == {1: "expired", 2: "pending", 3: "done", 4: "pending"}


def test_sheet_balance(spark):
    rows = spark.createDataFrame([("a", "1.00", ""), ("a", "x", "1.01"), ("b", None, "2"), ("b", "5", None)], "s string, d string, c string")
    got = {r.s: (r.total_debit, r.total_credit, r.balanced) for r in review.sheet_balance(rows, "s", "d", "c").collect()}
    assert got == {"a": (Decimal("1.00"), Decimal("1.01"), True), "b": (Decimal("5.00"), Decimal("2.00"), False)}


def test_label_sets(spark):
    rows = spark.createDataFrame([(1, 10, 5.0, 0.0), (1, 10, 5.0, 0.0), (1, 30, 0.0, 10.0), (2, None, 1.0, 0.0)], "move_id long, account long, debit double, credit double")
    got = {r.move_id: (r.debit_accounts, r.credit_accounts, r.n_lines) for r in review.label_sets(rows).collect()}
    assert got == {1: ([10], [30], 3), 2: ([], [], 1)}


def test_gate(spark):
    rows = spark.createDataFrame([(1, 0.75, 0.65), (2, 0.7, None)], "id long, debit double, journal double")
    got = {r.id: (r.blocked, r.allowed) for r in review.gate(rows, {"journal": 0.65, "debit": 0.75}).collect()}
    assert got == {1: ("", True), 2: ("debit,journal", False)}


def test_best_partner_ties_and_empty(spark):
    names = spark.createDataFrame([(1, "Acme Trading"), (2, None), (3, "zzz")], "k long, n string")
    partners = spark.createDataFrame([(9, "ACME trading"), (7, "acme Trading"), (8, "Acme")], "pid long, p string")
    got = review.best_partner(names, partners, "k", "n", "pid", "p").collect()
    assert [(r.k, r.partner_id, r.similarity) for r in got] == [(1, 7, 1.0)]
    assert review.best_partner(names.where("false"), partners, "k", "n", "pid", "p").count() == 0


def test_alias(spark):
    rows = spark.createDataFrame([(" BANK ",), (None,), ("x",)], "v string")
    assert [r.x for r in rows.select(review.alias_of(F.col("v"), {"bank": "bank"}, "general").alias("x")).collect()] == ["bank", "general", "general"]


def test_multi_label_mean(spark):
    found = spark.createDataFrame([(1, 0.5, [1, 1, 2]), (1, 0.5, [2])], "query_id long, score double, labels array<int>")
    assert {r.label: r.share for r in review.multi_label_mean(found, "labels").collect()} == {1: 0.5, 2: 1.0}


def test_find_references_searches_all_not_found(spark):
    moves = spark.createDataFrame([(k, f"note X{k:04d} end", None if k % 2 else f"ref-{k}") for k in range(1200)], "id long, name string, ref string")
    asked = spark.createDataFrame([(f"x{k:04d}",) for k in range(1200)] + [("ref-8",), ("nothing",)], "ref string")
    got = sorted((r.ref, r.id, r.how) for r in lookup.find_references(asked, moves, ["name", "ref"]).collect())
    assert got == sorted([(f"x{k:04d}", k, "contains") for k in range(1200)] + [("ref-8", 8, "exact")])
