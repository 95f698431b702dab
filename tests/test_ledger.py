"""The ledger operators against the cases of the fixtures and small brute-force versions."""

import datetime as dt
import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import documents, money, names, scores, text
from ledgerloom.operators import chain, journal, lookup, reconcile, retrieval, rules
from ledgerloom.sources import statements
from ledgerloom.streaming import limits

D = Decimal


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


SIDE = "idx long, date date, description string, amount decimal(20,2)"


def one(spark, column, **values):
    names_ = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in names_)).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [("1,234.50", "1234.50"), ("(50.00)", "-50.00"), ("12", "12.00"), ("", None), ("NaN", None), (".", "0.00"), ("-", None), ("SAR 7.5", "7.50"), ("١٢٣٫٤٥", "123.45"), ("999999999999999999.99", "999999999999999999.99"), ("1000000000000000000.00", None), (None, None)],
)
def test_parse_number(spark, raw, want):
    got = one(spark, money.parse_number(F.col("v")), v=raw)
    assert got == (None if want is None else D(want))


@pytest.mark.parametrize(
    "raw,want",
    [("2026-01-05", "2026-01-05"), ("5/1/2026", "2026-01-05"), ("01-25-2026", "2026-01-25"), ("5.1.26", "2026-01-05"), ("20260105", "2026-01-05"), ("٢٠٢٦/٠١/٠٥", "2026-01-05"), ("soon", "soon"), ("", ""), (None, ""), ("2026-13-45", "2026-13-45")],
)
def test_normalize_date(spark, raw, want):
    assert one(spark, text.normalize_date(F.col("v")), v=raw) == want


def test_money_sum_is_exact(spark):
    df = spark.createDataFrame([("0.10",), ("0.20",)], "v string")
    assert df.agg(F.sum(money.to_money(F.col("v")))).first()[0] == D("0.30")


@pytest.mark.parametrize("gross,base,tax", [("-115.00", "100.00", "15.00"), ("230.00", "200.00", "30.00"), ("0.01", None, None)])
def test_tax_split(spark, gross, base, tax):
    b, t = money.tax_split(F.col("g").cast("decimal(20,2)"), F.lit("15").cast("decimal(9,4)"))
    row = spark.createDataFrame([(gross,)], "g string").select(b.alias("b"), t.alias("t")).first()
    assert (row.b, row.t) == (base and D(base), tax and D(tax))


def greedy(statement, ledger, days):
    used, out = set(), set()
    for exact in (True, False):
        for s in sorted(statement):
            if ("s", s[0]) in used:
                continue
            for l in sorted(ledger):
                ok = s[3] == l[3] and (s[1] == l[1] if exact else abs((s[1] - l[1]).days) <= days)
                if ok and ("l", l[0]) not in used:
                    used |= {("s", s[0]), ("l", l[0])}
                    out.add((s[0], l[0]))
                    break
    return out


def test_reconcile_like_the_greedy_walk(spark):
    rng = random.Random(5)
    for _ in range(3):
        sides = [[(k, day(rng.randrange(40)), "x", D(rng.choice([100, 200, 300]))) for k in range(60)] for _ in range(2)]
        s, l = (spark.createDataFrame(x, SIDE) for x in sides)
        got = {(r.s_idx, r.l_idx) for r in reconcile.reconcile(s, l).collect()}
        assert got == greedy(*sides, 7)


def test_reconcile_cases(spark):
    def run(s, l):
        a, b = spark.createDataFrame(s, SIDE), spark.createDataFrame(l, SIDE)
        return reconcile.totals(a, b, reconcile.reconcile(a, b)).first()

    assert run([(1, day(4), "", D(-500))], [(1, day(4), "", D(-501))]).matched == 0
    r = run([(1, day(4), "", D(5000))], [(1, day(6), "", D(5000))])
    assert (r.matched, r.difference) == (1, 0)
    r = run([(1, day(4), "", D(-100))], [(1, day(4), "", D(-100)), (2, day(5), "", D(-100))])
    assert (r.matched, r.ledger_only) == (1, 1)
    r = run([(1, None, "", D(-100)), (2, day(1), "", None)], [])
    assert (r.matched, r.statement_only) == (0, 2)


C = rules.Condition


def test_rules(spark):
    txn = spark.createDataFrame([(1, day(0), "BANK FEE jan", D("-1.15")), (2, day(0), "bank fee", D("-5.00")), (3, day(0), "salary", D("10.00"))], SIDE)
    fee = rules.Rule(1, 1, 100, (C("description", "contains", "FEE"), C("amount", "lte", "2.00")), 200)
    assert [r.idx for r in rules.match_rules(txn, [fee]).collect()] == [1]
    better = rules.Rule(2, 1, 10, (C("direction", "equals", "outflow"),), 300)
    got = {r.idx: (r.status, r.rule_id, r.account_id) for r in rules.resolve(txn, [fee, better]).collect()}
    assert got == {1: ("matched", 2, 300), 2: ("matched", 2, 300), 3: ("unresolved", None, None)}
    tie = rules.Rule(3, 1, 10, (C("direction", "equals", "outflow"),), 400)
    assert {r.status for r in rules.resolve(txn, [better, tie]).where("idx < 3").collect()} == {"ambiguous"}
    zero = rules.Rule(4, 1, 0, (C("direction", "equals", "outflow"),), 500)  # acts as 100
    assert rules.resolve(txn, [better, zero]).first().rule_id == 2


@pytest.mark.parametrize("pattern,ok", [("(a+)+$", False), ("fee \\d+", True), ("(?=a)b", False), ("(a)\\1", False), ("x" * 300, False), ("(abc)+", True), ("(", False), ("((a*)b)+", False)])
def test_patterns(pattern, ok):
    assert (rules.pattern_error(pattern) is None) == ok


def test_entries_balance(spark):
    rows = [(1, day(0), "a", D("-1.00")), (2, day(0), "b", D("-2.00")), (3, day(1), "c", D("25.00")), (4, day(1), "d", D("0.00"))]
    resolved = spark.createDataFrame(rows, SIDE).withColumn("account_id", F.when(F.col("idx") < 3, 200).cast("long"))
    lines = journal.entry_lines(resolved, 100)
    got = {str(r.entry_date): r for r in journal.daily_entries(lines).collect()}
    first, second = got[str(day(0))], got[str(day(1))]
    assert (first.transactions, first.lines, first.total_debit, first.balanced, first.ready_for_review) == (2, 4, D("3.00"), True, True)
    assert (second.unresolved, second.balanced, second.ready_for_review) == (1, True, False)
    bank = lines.where("role = 'bank' AND source_row = 3").first()
    assert (bank.debit, bank.credit) == (D("25.00"), 0)
    twice = journal.entry_lines(resolved.union(resolved.where("idx = 1")), 100)
    assert journal.daily_entries(twice).where("duplicates > 0").count() == 1
    assert journal.duplicate_sources(twice).count() == 1


def test_tax_line(spark):
    rows = spark.createDataFrame([(1, day(0), "a", D("-115.00"))], SIDE).select("*", F.lit(7).cast("long").alias("account_id"), F.lit("15").cast("decimal(9,4)").alias("rate"))
    got = {r.role: (r.debit, r.credit) for r in journal.entry_lines(rows, 100, "rate", 300).collect()}
    assert got == {"bank": (0, D("115.00")), "counterpart": (D("100.00"), 0), "tax": (D("15.00"), 0)}


@pytest.mark.parametrize(
    "lines,error",
    [([("0.10", "0"), ("0.20", "0"), ("0", "0.30")], None), ([("1", "0")], "too_few_lines"), ([("1", "0"), ("0", "2")], "unbalanced"), ([("1", "1"), ("0", "0")], "one_side_only"), ([("-1", "0"), ("0", "-1")], "negative_amount")],
)
def test_balance(spark, lines, error):
    df = spark.createDataFrame([(1, D(a), D(b)) for a, b in lines], "entry_id long, debit decimal(20,2), credit decimal(20,2)")
    assert journal.balance_errors(df).first().error == error


def test_chain(spark):
    events = spark.createDataFrame([(s, k, f"e{k}", None if k == 2 else k) for s in (1, 2, None) for k in range(5)], "scope long, id long, kind string, n long")
    made = chain.append(events, "scope", "id", ["kind", "n"])
    rows = made.where("scope = 1").orderBy("sequence_number").collect()
    previous = chain.GENESIS
    for k, r in enumerate(rows, 1):
        n = "null" if r.n is None else r.n
        assert (r.sequence_number, r.previous_hash) == (k, previous)
        previous = hashlib.sha256(f'{k}|{previous}|{{"kind":"{r.kind}","n":{n}}}'.encode()).hexdigest()
        assert r.event_hash == previous
    assert chain.verify(made, "scope", ["kind", "n"]).where("NOT ok").count() == 0
    spoiled = made.withColumn("kind", F.when((F.col("id") == 3) & (F.col("scope") == 2), "x").otherwise(F.col("kind")))
    bad = chain.verify(spoiled, "scope", ["kind", "n"]).where("NOT ok").collect()
    assert [(r.scope, r.failed_at, r.code) for r in bad] == [(2, 4, "event_hash")]
    missing = made.where("NOT (scope <=> 1 AND id = 1)")
    assert [(r.scope, r.code) for r in chain.verify(missing, "scope", ["kind", "n"]).where("NOT ok").collect()] == [(1, "gap")]


def test_rate_limit(spark):
    times = [0, 1, 2, 3, 61, 62, 63, 200]
    start = dt.datetime(2026, 1, 1)
    df = spark.createDataFrame([(k, a, start + dt.timedelta(seconds=s)) for a in (1, 2) for k, s in enumerate(times)], "event_id long, actor long, ts timestamp")
    got = limits.rate_limit(df, most=3, seconds=60).where("actor = 1").orderBy("event_id").collect()
    assert [r.accepted for r in got] == [True, True, True, False, True, True, True, True]


def test_rate_limit_stream(spark, tmp_path):
    start = dt.datetime(2026, 1, 1)
    schema = "event_id long, actor long, ts timestamp"
    df = spark.createDataFrame([(k, k % 2, start + dt.timedelta(seconds=k)) for k in range(20)], schema)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = limits.rate_limit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), most=3, seconds=60)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("limited").where("accepted").count() == 6 and spark.table("limited").count() == 20


def test_pending(spark):
    rows = [(1, 1, 1, 0, 10), (2, 1, 1, 5, 6), (3, 2, 1, 5, 6), (4, 1, 1, 11, 12)]
    df = spark.createDataFrame(rows, "job_id long, actor long, org long, started long, finished long")
    assert {r.job_id: r.reason for r in limits.pending_caps(df, 1, 5).collect()} == {1: None, 2: "actor_pending", 3: None, 4: None}
    assert {r.job_id: r.reason for r in limits.pending_caps(df, 5, 1).collect()} == {1: None, 2: "organization_pending", 3: "organization_pending", 4: None}


def test_statement_files(spark, tmp_path):
    files = {
        "a.csv": "My bank\nstatement\nDate,Description,Debit,Credit\n2026-01-05,\"ATM, city\",150.00,\n06/01/2026,Salary,,\"5,000.00\"\n,none,1,\n2026-01-07,zero,0,0\n",
        "b.txt": "تاريخ|البيان|مدين|دائن\n٢٠٢٦-٠١-١١|إيداع نقدي||٥٠٠٠٫٠٠\n",
        "c.ofx": "<OFX><BANKTRANLIST><STMTTRN><DTPOSTED>20260105120000<TRNAMT>-12.50<NAME>Shop<MEMO>food</STMTTRN><STMTTRN><DTUSER>20260106<TRNAMT>7<FITID>X1</STMTTRN></BANKTRANLIST></OFX>",
        "d.qif": "!Type:Bank\nD01/05/2026\nT-5.00\nPFee\n^\nD2026-01-06\nT9\nMlast\n",
        "e.sta": "Date;Details;Amount\n2026-01-05;Fee;(3.25)\n",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body.encode("utf-8"))
    (tmp_path / "f.txt").write_bytes("Date|Description|Amount\n2026-01-05|رسوم|-1\n".encode("cp1256"))
    read = statements.read_files(spark, str(tmp_path))
    parsed = statements.require(read, statements.parse(read))
    got = sorted((r.path.rsplit("/", 1)[1], r.row_number, r.date, r.description, str(r.amount)) for r in parsed.collect())
    assert got == [
        ("a.csv", 1, "2026-01-05", "ATM, city", "-150.00"), ("a.csv", 2, "2026-01-06", "Salary", "5000.00"), ("b.txt", 1, "2026-01-11", "إيداع نقدي", "5000.00"),
        ("c.ofx", 1, "2026-01-05", "Shop food", "-12.50"), ("c.ofx", 2, "2026-01-06", "X1", "7.00"), ("d.qif", 5, "2026-05-01", "Fee", "-5.00"), ("d.qif", 9, "2026-01-06", "last", "9.00"),
        ("e.sta", 1, "2026-01-05", "Fee", "-3.25"), ("f.txt", 1, "2026-01-05", "رسوم", "-1.00"),
    ]
    (tmp_path / "g.doc").write_bytes(b"?")
    read = statements.read_files(spark, str(tmp_path))
    with pytest.raises(ValueError, match="unknown kind"):
        statements.require(read, statements.parse(read))


def test_names(spark):
    from difflib import SequenceMatcher

    df = spark.createDataFrame([("acme trading", "acme trade"), ("", "x"), ("محمد", "محمد احمد")], "a string, b string")
    for r in df.select("a", "b", names.sequence_ratio("a", "b").alias("x")).collect():
        assert r.x == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio() if r.a and r.b else 0.0)
    assert one(spark, names.latin(F.col("v")), v="خالد") == "khald"
    assert one(spark, names.skeleton(F.col("v")), v="Yousef") == "ysf"
    assert one(spark, names.skeleton(F.col("v"), relaxed=True), v="Mohammed") == one(spark, names.skeleton(F.col("v"), relaxed=True), v="محمد")
    assert one(spark, names.spans(F.col("v"), 2), v="a b c") == ["a", "b", "c", "a b", "b c"]


def test_document_fields(spark):
    body = "Invoice Number INV-001\nSubtotal 4,000.00\nVAT Tax 600.00\nTotal Amount 4,600.00 SAR"
    f = documents.invoice_fields(F.col("t"))
    row = spark.createDataFrame([(body,)], "t string").select(documents.document_class(F.col("t")).alias("c"), *[v.alias(k) for k, v in f.items()]).first()
    assert (row.c, row.invoice_number, row.taxable, row.vat, row.total) == ("invoice", "INV-001", D("4000.00"), D("600.00"), D("4600.00"))


def test_redaction(spark):
    left, counts = text.redact(F.col("t"))
    row = spark.createDataFrame([("mail a.b@c.org, see https://x.y/z and SA0380000000608010167519",)], "t string").select(left.alias("l"), counts["email"].alias("e"), counts["iban"].alias("i")).first()
    assert (row.l, row.e, row.i) == ("mail [REDACTED:email], see https://x.y/z and [REDACTED:iban]", 1, 1)


def test_domain(spark):
    df = spark.createDataFrame([(k, f"n{k}") for k in range(6)], "id long, name string")
    terms = ["|", ("id", "=", 1), "&", ("id", ">", 3), "!", ("name", "ilike", "N5")]
    assert [r.id for r in df.where(lookup.domain(terms)).orderBy("id").collect()] == [1, 4]
    assert df.where(lookup.domain([])).count() == 6
    assert df.where(lookup.domain([("id", "in", [1, 2]), ("id", "!=", 2)])).count() == 1


def test_votes(spark):
    found = spark.createDataFrame([(1, 0.9, [10, 10, None]), (1, 0.3, [10, 20]), (1, 0.5, [])], "query_id long, score double, labels array<long>")
    got = {r.label: r.vote for r in retrieval.weighted_vote(found).collect()}
    assert got[10] == pytest.approx((0.9 + 0.15) / 1.2) and got[20] == pytest.approx(0.15 / 1.2)


def test_scores(spark):
    a = lambda x, y: one(spark, scores.amount_score(F.col("x").cast("double"), F.col("y").cast("double")), x=x, y=y)
    assert [a("100", "100.5"), a("0", "0"), a("0", "1"), a("1000", "1015"), a("100", "50"), a(None, "1")] == [1.0, 1.0, 0.0, 0.95 if 1000 / 1015 >= 0.99 else 0.85, 0.0, 0.0]
    b = lambda x: one(spark, scores.amount_bucket(F.col("x").cast("decimal(20,2)")), x=x)
    assert [b("0"), b("99.99"), b("100"), b("9999"), b("1000000"), b(None)] == ["zero", "lt_100", "100_999", "1k_9k", "gte_1m", "unknown"]


def test_every_query_has_rows_or_a_schema(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
