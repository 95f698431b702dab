"""Suggestions that no SQL can express, against plain Python."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names, text
from ledgerloom.operators import drafts, retrieval, review, suggest
from ledgerloom.plans import learners, more, people

WORDS = re.compile(r"\b(ref|reference|txn|transaction|date|time|sar|vat|iban|swift|mada|visa|card|bank)\b")


def norm(s):
    s = re.sub(r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", " ", (s or "").lower())
    return re.sub(r"\s+", " ", re.sub(r"[^\w]+", " ", WORDS.sub(" ", s))).strip()


def alike(a, b, digits=True):
    a, b = norm(a), norm(b)
    if not a or not b:
        return 0.0
    x, y = ({w for w in t.split() if len(w) > 2 and (digits or not w.isdigit())} for t in (a, b))
    return max(SequenceMatcher(None, a, b).ratio(), len(x & y) / max(len(x | y), 1))


TEXTS = ["monthly service fee 2024-01-05", "Monthly service fees", "payroll run march", "PAYROLL run april", "", None, "mada pos settlement 991", "transfer to acme ltd", "transfer to acme limited"]


def test_near_duplicates(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for least in (0.5, 0.8, 0.92):
        got = {r.k: r.similarity for r in suggest.near_duplicates(spark.createDataFrame(rows, "k long, description string"), "k", least=least).collect()}
        want = {}
        for i, t in rows:
            best = max((SequenceMatcher(None, t, u).ratio() for _, u in rows if t and u and t != u), default=0)
            if best >= least:
                want[i] = round(best, 3)
        assert got == want


def test_historical_entries(spark):
    past = [(10 + i, 1, i, t or "", f"line {i % 2}", 100.0 + 10 * i) for i, t in enumerate(TEXTS)]
    asked = [(1, "service fee for january", -100.0), (2, "acme limited transfer", 171.0), (3, "zzz", 0.0)]
    history = spark.createDataFrame(past, "entry_id long, line_id int, account_id long, bank_text string, line_text string, bank_amount double")
    got = {r.k: r for r in suggest.historical_entry(spark.createDataFrame(asked, "k long, description string, amount double"), history, "k").collect()}
    kinds = {"fee": "bank_fees", "payroll": "payroll", "transfer": "transfer", "pos": "pos_settlement"}

    def kind(t):
        return next((v for k, v in kinds.items() if k in norm(t)), "general")

    def amount(a, b):
        a, b = abs(a), abs(b)
        r = min(a, b) / max(a, b) if a and b else 0
        return next((s for bound, s in ((0.995, 1.0), (0.98, 0.82), (0.95, 0.65), (0.9, 0.45)) if r >= bound), 0.0)

    for k, t, a in asked:
        scored = [(-round(min(1.0, max(alike(t, b, False), alike(t, l, False)) * 0.82 + amount(a, m) * 0.12 + (kind(t) != "general" and kind(t) == kind(b)) * 0.06), 4), e, n, c) for e, n, c, b, l, m in past]
        best = min(scored)
        assert (got[k].entry_id, got[k].account_id, got[k].confidence, got[k].needs_review) == (best[1], best[3], -best[0], -best[0] < 0.6)


def test_historical_entries_in_blocks(spark):
    """All pairs meet in whatever blocks; a movement's own entry is left out, also where it is the first of equal ones."""
    left, right = spark.range(23).select(F.col("id").alias("a")), spark.range(31).select(F.col("id").alias("b"))
    assert {(r.a, r.b) for r in suggest.paired(left, right, 5).collect()} == {(a, b) for a in range(23) for b in range(31)}
    assert suggest.paired(left, right.where("b < 0"), 5).collect() == []
    rows = [(k, f"transfer to {('acme', 'bolt', 'crux', 'dyne')[k % 4]}", 100.0) for k in range(12)] + [(50, "alone here", 7.0)]
    df = spark.createDataFrame(rows, "k long, description string, amount double")
    past = df.select(F.col("k").alias("entry_id"), F.lit(1).alias("line_id"), F.col("k").alias("account_id"), F.col("description").alias("bank_text"), F.lit("").alias("line_text"), F.col("amount").alias("bank_amount"))
    got = {r.k: r.entry_id for r in suggest.historical_entry(df, past, "k", own=True).collect()}
    assert {k: got[k] for k in range(12)} == {k: k + 4 if k < 4 else k % 4 for k in range(12)} and got[50] != 50


def test_fuzzy_rules(spark):
    rules = [(1, 10, "bank service charges", "fee", None, None, None), (2, 20, "payroll run", "salary", "greater", 50.0, None), (3, 30, "pos settlement", "", "lower", None, 10.0)]
    df = spark.createDataFrame(rules, "rule_id long, account_id long, rule_text string, label_value string, mode string, low double, high double")
    rows = [(i, t, 60.0) for i, t in enumerate(TEXTS)]
    got = {r.k: (r.rule_id, r.confidence) for r in suggest.fuzzy_rule(spark.createDataFrame(rows, "k long, description string, amount double"), df, "k").collect()}
    kind = {0: "bank_fees", 1: "bank_fees", 2: "payroll", 3: "payroll", 6: "pos_settlement", 7: "transfer", 8: "transfer"}
    of_rule = {1: "bank_fees", 2: "payroll", 3: "pos_settlement"}
    for i, t, _ in rows:
        scored = []
        for rid, _, body, label, mode, _, _ in rules:
            score = max(alike(t, body), 1.0 if norm(label) and norm(label) in norm(t) else 0.0) * 0.62 + 0.18 * (kind.get(i) == of_rule[rid]) + {None: 0.45, "greater": 1.0, "lower": 0.0}[mode] * 0.2
            scored.append((-round(min(score, 1.0), 4), rid))
        best = min(scored)
        assert got.get(i) == ((best[1], -best[0]) if -best[0] >= 0.42 else None), i


def test_smart_matches_use_a_row_once(spark):
    found = [(1, 7, 0.9), (1, 8, 0.8), (2, 7, 0.95), (2, 8, 0.7), (3, 8, 0.99), (4, 9, 0.3)]
    df = spark.createDataFrame(found, "s_idx long, l_idx long, vector double").withColumns({"s_amount": F.lit(5).cast("decimal(20,2)"), "l_amount": F.lit(50).cast("decimal(20,2)")})
    assert sorted((r.s_idx, r.l_idx) for r in suggest.smart_matches(df).collect()) == [(1, 7), (2, 8)]


def test_best_partner_against_all_pairs(spark):
    asked = [(i, t) for i, t in enumerate(["Acme Trading", "acme", "zz", "", None, "Nile Foods Co"])]
    there = [(10, "ACME trade"), (11, "Acme"), (12, "Nile Food"), (13, ""), (14, "z"), (15, "acme")]
    got = {r.k: (r.partner_id, r.similarity) for r in review.best_partner(spark.createDataFrame(asked, "k long, name string"), spark.createDataFrame(there, "id long, partner string"), "k", "name", "id", "partner", 0.4).collect()}

    def dice(a, b):
        from collections import Counter

        x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
        return 1.0 if a == b else 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x and y else 0.0

    for k, t in asked:
        best = min(((-round(dice(t.lower(), u.lower()), 6), i) for i, u in there), default=None) if t is not None else None
        assert got.get(k) == ((best[1], -best[0]) if best and -best[0] >= 0.4 else None), k


def test_partner_similarity(spark):
    pairs = [("acme trading", "acme trade"), ("acme", "acme co"), ("", "x"), ("nile", "food")]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", names.partner_similarity(F.col("a"), F.col("b")).alias("s")).collect():
        x, y = set(r.a.split()), set(r.b.split())
        base = 0.75 * SequenceMatcher(None, r.a, r.b).ratio() + 0.25 * (len(x & y) / max(len(x), len(y)) if x and y else 0)
        within = 0.15 if r.a in r.b or r.b in r.a else 0.0
        assert r.s == pytest.approx(min(1.0, base + within) if r.a and r.b else 0.0)


def test_nearest_in_blocks(spark, monkeypatch):
    rows = [(i, [float((i * 7) % 5), float(i % 3), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>")
    asked = df.select(F.col("row_id").alias("query_id"), "vector").where("row_id < 11")
    one = sorted(map(tuple, retrieval.nearest(asked, df, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    assert sorted(map(tuple, retrieval.nearest(asked, df, 4).collect())) == one and len(one) == 44


def test_redaction_counts_what_is_left(spark):
    given = "Customer: Ali\nmail a@b.co, iban SA0380000000608010167519; SAR 1,500.25"
    left, counts = text.redact(F.lit(given))
    r = spark.range(1).select(left.alias("t"), *[c.alias(k) for k, c in counts.items()]).first()
    assert r.t == "[REDACTED:labeled_party_or_address]\nmail [REDACTED:email], iban [REDACTED:iban]; [REDACTED:financial_value]"
    assert (r.labeled_party_or_address, r.email, r.iban, r.financial_value) == (1, 1, 1, 1)
    assert "1,500.25" in spark.range(1).select(text.redact(F.lit(given), allow_amounts=True)[0]).first()[0]


def test_queries_of_functions_have_sql():
    without = {"j04_smart_match", "j10_fuzzy_rules", "j11_historical_entries", "w07_near_duplicates", "f15_partner_similarity", "r03_rate_limit", "w03_chain_append"}
    without |= {"f10_description_score", "j19_name_match", "j20_global_search", "m04_predictor", "m07_name_training"}  # tests/test_name_match.py, test_text_index.py, test_learning.py
    assert learners.QUERIES is people.QUERIES is more.QUERIES
    assert set(more.QUERIES) - set(more.ORACLES) == without


def test_enrichment_needs_a_clear_partner(spark):
    rows = spark.createDataFrame([(1, "asset_cash", "expense", [(3, 0.9, True)]), (2, "asset_cash", "asset_cash", []), (3, "expense", "asset_cash", None)], "k long, debit_type string, credit_type string, analytics array<struct<id:long,score:double,resolved:boolean>>")
    partners = spark.createDataFrame([(1, 5, 0.9, True), (1, 6, 0.8, True), (3, 7, 0.9, True), (3, 8, 0.95, False)], "k long, id long, confidence double, resolved boolean")
    got = {r.k: (r.side, r.partner_id, r.analytic_id) for r in drafts.enrich(rows, partners, "k").collect()}
    assert got == {1: ("credit", None, 3), 2: (None, None, None), 3: ("debit", 7, None)}


def test_near_amounts(spark):
    """Every move in range, the closest ones only where there are more, against a plain loop; amounts at the edges of bands and ranges."""
    import datetime
    import random
    from decimal import Decimal

    from ledgerloom.operators import reconcile

    rng, day = random.Random(4), datetime.date(2024, 1, 1)
    docs = [(k, Decimal(rng.choice([100, 101, 200, 1000])) + Decimal(rng.randrange(300)) / 100, day + datetime.timedelta(days=rng.randrange(30))) for k in range(60)] + [(90, None, day), (91, Decimal(-5), day), (92, Decimal(100), None)]
    moves = [(k, Decimal(rng.choice([99, 100, 101, 198, 990])) + Decimal(rng.randrange(400)) / 100, day + datetime.timedelta(days=rng.randrange(30))) for k in range(400)] + [(900, Decimal("101.00"), day), (901, Decimal("99.00"), day)]
    d = spark.createDataFrame(docs + [(95, Decimal(100), day)], "d_id long, d_amount decimal(20,2), d_date date")
    m = spark.createDataFrame(moves, "m_id long, m_amount decimal(20,2), m_date date")
    for most in (3, 1000):
        got = {(r.d_id, r.m_id) for r in reconcile.near_amounts(d, m, most=most).collect()}
        want = set()
        for i, a, t in [*docs, (95, Decimal(100), day)]:
            if a and a > 0 and t:
                near = sorted((abs(a - b), j) for j, b, u in moves if a * Decimal("0.99") <= b <= a * Decimal("1.01") and abs((t - u).days) <= 4)
                want |= {(i, j) for _, j in near[:most]}
        assert got == want and ({(95, 900), (95, 901)} <= want or most == 3)


def test_description_score(spark):
    from ledgerloom.functions import scores

    cases = [("Invoice INV/2024/7 for Acme", "INV/2024/7", "Acme"), ("nothing alike", "zz/1", None), ("", "a", "b"), ("text", None, None), (None, "abc", "d"), ("x" * 3000 + " abc", "abc", None), ("Paid AC", "ac", "of")]

    def plain(doc, *parts):
        doc, move = (re.sub(r"\s+", " ", re.sub(r"[^\w\s:/#.\-]", " ", x.lower())).strip() for x in (doc or "", " ".join(p for p in parts if p is not None)))
        if not doc or not move:
            return 0.0
        words = [w for w in re.findall(r"[\w/\-]+", move) if len(w) >= 3]
        share = sum(w in doc for w in words) / len(words) if words else 0.0
        return max(share, SequenceMatcher(None, doc[:1200], move).ratio())

    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, d string, a string, b string")
    got = {r.k: r.s for r in df.select("k", scores.description_score(F.col("d"), F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(got[k] == pytest.approx(plain(*c)) for k, c in enumerate(cases)) and got[5] == 1.0
