"""Registered queries of single functions, drafts, taxes, catalogs and suggestions, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import documents, money, names, scores, text
from ..operators import drafts, journal, lookup, retrieval, review, rules, suggest
from ..sources import statements
from . import tables as t
from .queries import query
from .review import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

MONEY = "decimal(20,2)"


def pick(key: Column, *values: str | None) -> Column:
    """One of the values by ``key`` modulo their number."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def orders(spark, d):
    return t.table(spark, d, "orders").withColumn("k", F.col("o_orderkey")).withColumn("v", F.col("o_totalprice").cast(MONEY))


ORDERS = "o AS (SELECT *, o_orderkey AS k, CAST(o_totalprice AS DECIMAL(20, 2)) AS v FROM orders)"

# --- files and their rows ------------------------------------------------------------------------------------------------------


@query("s01_format_dispatch", f"WITH {ORDERS}, f AS (SELECT k, ['csv', 'OFX', 'qif', 'doc'][k % 4 + 1] AS e FROM o) SELECT k, lower(e) AS kind, lower(e) IN ('csv', 'tsv', 'txt', 'mt940', 'sta', 'ofx', 'qfx', 'qif') AS known FROM f")
def s01(spark, d):
    path = F.concat(F.lit("dir/file"), F.col("k"), F.lit("."), pick(F.col("k"), "csv", "OFX", "qif", "doc"))
    kind = statements.kind_of(path)
    return orders(spark, d).select("k", kind.alias("kind"), kind.isin(*statements.KINDS).alias("known"))


@query(
    "s02_csv_statement",
    f"""WITH {ORDERS} SELECT 'f' || (k // 500) || '.csv' AS path, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Paid, order ' || k AS description, CAST(CASE WHEN k % 2 = 0 THEN v ELSE -v END AS DECIMAL(20, 2)) AS amount FROM o WHERE v <> 0""",
)
def s02(spark, d):
    k, v = F.col("k"), F.col("v").cast("string")
    cells = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit('"Paid, order '), k, F.lit('"')), F.when(k % 2 == 1, v).otherwise(""), F.when(k % 2 == 0, v).otherwise(""))
    return _file_rows(orders(spark, d), cells, "Date,Description,Debit,Credit\n", "csv").select("path", "date", "description", "amount")


def _file_rows(rows, line: Column, head: str, kind: str, tail: str = "", per_file: int = 500):
    """Transactions of files of at most ``per_file`` lines made from ``rows``."""
    grouped = rows.select((F.floor(F.col("k") / per_file)).alias("f"), "k", line.alias("line")).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("ls"))
    files = grouped.select(F.concat(F.lit("f"), "f", F.lit(f".{kind}")).alias("path"), F.lit(kind).alias("kind"), F.concat(F.lit(head), F.array_join("ls.line", "\n"), F.lit(tail)).alias("text"))
    return statements.parse(files)


@query("s06_ofx_statement", f"WITH {ORDERS} SELECT 'f' || (k // 500) || '.ofx' AS path, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Shop ' || k || ' memo' AS description, CAST(-v AS DECIMAL(20, 2)) AS amount FROM o WHERE v <> 0")
def s06(spark, d):
    block = F.concat(F.lit("<STMTTRN><DTPOSTED>"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000<TRNAMT>-"), F.col("v").cast("string"), F.lit("<NAME>Shop "), F.col("k"), F.lit("<MEMO>memo</STMTTRN>"))
    return _file_rows(orders(spark, d), block, "<OFX><BANKTRANLIST>", "ofx", "</BANKTRANLIST></OFX>").select("path", "date", "description", "amount")


@query("s07_qif_statement", f"WITH {ORDERS} SELECT 'f' || (k // 500) || '.qif' AS path, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Fee ' || k || ' note' AS description, v AS amount FROM o WHERE v <> 0")
def s07(spark, d):
    record = F.concat(F.lit("D"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("\nT"), F.col("v").cast("string"), F.lit("\nPFee "), F.col("k"), F.lit("\nMnote\n^"))
    return _file_rows(orders(spark, d), record, "!Type:Bank\n", "qif").select("path", "date", "description", "amount")


@query("s10_decode_ladder", "SELECT doc_id, text AS decoded FROM documents WHERE text IS NOT NULL")
def s10(spark, d):
    raw = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return t.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", statements.decoded(raw).alias("decoded"))


@query("s21_file_type", "SELECT doc_id, ['pdf', 'zip', 'png', 'text', 'unknown'][doc_id % 5 + 1] AS kind FROM documents WHERE length(coalesce(text, '')) > 0")
def s21(spark, d):
    magic = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("255044462D"))).when(F.col("doc_id") % 5 == 1, F.unhex(F.lit("504B0304"))).when(F.col("doc_id") % 5 == 2, F.unhex(F.lit("89504E470D0A1A0A"))).when(F.col("doc_id") % 5 == 4, F.unhex(F.lit("0001020003000405"))).otherwise(F.unhex(F.lit("")))
    body = F.when(F.col("doc_id") % 5 == 4, F.unhex(F.lit(""))).otherwise(F.encode("text", "UTF-8"))
    return t.table(spark, d, "documents").where("length(coalesce(text, '')) > 0").select("doc_id", statements.file_type(F.concat(magic, body)).alias("kind"))


@query("s23_json_lines", f"WITH {ORDERS} SELECT k AS id, o_orderpriority AS name, v AS amount FROM o WHERE k % 7 <> 0")
def s23(spark, d):
    made = F.to_json(F.struct(F.col("k").alias("id"), F.col("o_orderpriority").alias("name"), F.col("v").cast("string").alias("amount")))
    lines = orders(spark, d).select(F.when(F.col("k") % 7 == 0, F.lit("{broken")).otherwise(made).alias("value"))
    return statements.json_rows(lines, "id long, name string, amount string").select("id", "name", F.col("amount").cast(MONEY).alias("amount"))


HEADER = "h AS (SELECT k // 100 AS f, k % 100 AS r, k FROM o)"


def _grid(spark, d):
    """Files of a hundred rows whose header stands in row 2, 3 or 4."""
    r, f = F.col("k") % 100, F.floor(F.col("k") / 100)
    head = F.array(F.lit("Value date"), F.lit("Details"), F.lit("Withdrawal"), F.lit("Deposit"))
    data = F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("row "), r), F.when(r % 2 == 0, F.col("v").cast("string")).otherwise(""), F.when(r % 2 == 1, F.col("v").cast("string")).otherwise(""))
    cells = F.when(r < f % 3 + 1, F.array(F.lit("My bank"))).when(r == f % 3 + 1, head).otherwise(data)
    return orders(spark, d).select(f.cast("string").alias("path"), (r + 1).cast("int").alias("row"), cells.alias("cells"))


@query("p01_header_rows", f"WITH {ORDERS}, {HEADER} SELECT CAST(f AS VARCHAR) AS path, CAST(f % 3 + 2 AS INTEGER) AS header_row FROM h WHERE r = f % 3 + 1")
def p01(spark, d):
    return statements.headers(_grid(spark, d)).where("c_date >= 0").select("path", "header_row")


@query("p02_columns", f"WITH {ORDERS}, {HEADER} SELECT CAST(f AS VARCHAR) AS path, 0 AS c_date, 1 AS c_description, -1 AS c_amount, 2 AS c_debit, 3 AS c_credit FROM h WHERE r = f % 3 + 1")
def p02(spark, d):
    return statements.headers(_grid(spark, d)).where("c_date >= 0").select("path", "c_date", "c_description", "c_amount", "c_debit", "c_credit")


@query(
    "p03_row_transactions",
    f"WITH {ORDERS}, {HEADER} SELECT CAST(f AS VARCHAR) AS path, CAST(r - f % 3 - 1 AS INTEGER) AS row_number, strftime(o.o_orderdate, '%Y-%m-%d') AS date, 'row ' || r AS description, CAST(CASE WHEN r % 2 = 0 THEN -v ELSE v END AS DECIMAL(20, 2)) AS amount FROM h JOIN o USING (k) WHERE r > f % 3 + 1 AND v <> 0",
)
def p03(spark, d):
    return statements.transactions(_grid(spark, d)).select("path", "row_number", "date", "description", "amount")


@query("k06_sheet_grid", f"WITH {ORDERS}, {HEADER} SELECT CAST(f AS VARCHAR) AS path, CASE WHEN r % 2 = 0 THEN CAST(v AS VARCHAR) ELSE '' END AS debit, CASE WHEN r % 2 = 1 THEN CAST(v AS VARCHAR) ELSE '' END AS credit, '' AS balance, 'row ' || r AS description FROM h JOIN o USING (k) WHERE r > f % 3 + 1 AND v <> 0")
def k06(spark, d):
    return statements.as_grid(statements.transactions(_grid(spark, d))).select("path", "debit", "credit", "balance", "description")


@query("w10_row_numbers", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS row_number FROM lineitem")
def w10(spark, d):
    by = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"))
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(by).alias("row_number"))


@query(
    "p04_ledger_rows",
    f"WITH {ORDERS}, l AS (SELECT k, 'N' || (k % 3) AS n, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'N' || (k % 3) ELSE 'R' || k END AS r, CASE WHEN k % 2 = 0 THEN v ELSE 0 END AS debit, CASE WHEN k % 2 = 1 THEN v ELSE 0 END AS credit FROM o WHERE k % 11 <> 0) SELECT k AS row_number, CASE WHEN r <> '' AND r <> n THEN n || ' - ' || r ELSE n END AS description, CAST(debit - credit AS DECIMAL(20, 2)) AS amount FROM l WHERE debit <> credit",
)
def p04(spark, d):
    k = F.col("k")
    n = F.concat(F.lit("N"), (k % 3).cast("string"))
    r = F.when(k % 4 == 0, "").when(k % 4 == 1, n).otherwise(F.concat(F.lit("R"), k.cast("string")))
    v = F.when(k % 11 == 0, "n/a").otherwise(F.col("v").cast("string"))
    lines = orders(spark, d).select("k", n.alias("name"), r.alias("ref"), F.when(k % 2 == 0, v).otherwise("0").alias("debit"), F.when(k % 2 == 1, v).otherwise("0").alias("credit"))
    return drafts.ledger_rows(lines, "k")


# --- predicates and rules ------------------------------------------------------------------------------------------------------


@query(
    "p05_text_predicates",
    "SELECT c_custkey, c_mktsegment LIKE '%MACH%' AS contains, c_mktsegment NOT LIKE '%MACH%' AS not_contains, c_mktsegment = 'HOUSEHOLD' AS equals, starts_with(c_mktsegment, 'AUTO') AS starts_with, ends_with(c_mktsegment, 'ING') AS ends_with, regexp_matches(c_mktsegment, '^[A-H].*E') AS regex FROM customer",
)
def p05(spark, d):
    given = {"contains": "mach", "not_contains": "mach", "equals": " household ", "starts_with": "auto", "ends_with": "ing", "regex": "^[a-h].*e"}
    made = [rules.holds(rules.Condition("description", op, value), F.col("c_mktsegment"), F.lit(1)).alias(op) for op, value in given.items()]
    return t.table(spark, d, "customer").select("c_custkey", *made)


@query(
    "p06_amount_predicates",
    "WITH c AS (SELECT c_custkey, CAST(c_acctbal AS DECIMAL(20, 2)) AS a, abs(CAST(c_acctbal AS DECIMAL(20, 2))) AS m FROM customer) SELECT c_custkey, m = 500 AS equals, m > 500 AS gt, m >= 500 AS gte, m < 500 AS lt, m <= 500 AS lte, m BETWEEN 100 AND 900 AS between_, a > 0 AS inflow, a < 0 AS outflow FROM c",
)
def p06(spark, d):
    a = F.col("c_acctbal").cast(MONEY)
    made = [rules.holds(rules.Condition("amount", op, "-500"), F.lit(""), a).alias(op) for op in ("equals", "gt", "gte", "lt", "lte")]
    made.append(rules.holds(rules.Condition("amount", "between", low="900", high="100"), F.lit(""), a).alias("between_"))
    made += [rules.holds(rules.Condition("direction", "equals", x), F.lit(""), a).alias(x) for x in ("inflow", "outflow")]
    return t.table(spark, d, "customer").select("c_custkey", *made)


_DEFINITIONS = {
    1: (rules.Condition("description", "contains", "fee"),),
    2: (),
    3: (rules.Condition("amount", "contains", "1"),),
    4: (rules.Condition("description", "regex", "(a+)+"),),
    5: (rules.Condition("description", "regex", "x(?=y)"),),
    6: (rules.Condition("description", "regex", r"(a)\1"),),
    7: (rules.Condition("description", "regex", "("),),
    8: tuple(rules.Condition("direction", "equals", "inflow") for _ in range(13)),
}


@query("p07_rule_validation", "SELECT * FROM (VALUES (1, ''), (2, 'conditions'), (3, 'amount.contains'), (4, 'regex: nested quantifier'), (5, 'regex: lookaround'), (6, 'regex: back-reference'), (7, 'regex: syntax'), (8, 'conditions')) v(rule_id, errors)")
def p07(spark, d):
    return spark.createDataFrame([(k, ", ".join(rules.rule_errors(rules.Rule(k, 1, 1, c)))) for k, c in _DEFINITIONS.items()], "rule_id int, errors string")


_MODEL_RULES = [
    suggest.ModelRule(1, None, label="contains", label_value="a"),
    suggest.ModelRule(2, 20),
    suggest.ModelRule(3, 30, label="contains", label_value="Urgent", amount="greater", low=300000),
    suggest.ModelRule(4, 40, label="not_contains", label_value="-", amount="between", low=-200000, high=100000),
    suggest.ModelRule(5, 50, label="match_regex", label_value="^[45]", amount="lower", high=50000),
    suggest.ModelRule(6, 60, label="equals", label_value="x"),
    suggest.ModelRule(7, 70, partners=(1, 2, 3)),
    suggest.ModelRule(8, 80, low=0.0, high=0.0),
    suggest.ModelRule(9, 90, low=0.0, high=20000.0),
]


@query(
    "j09_strict_rule_match",
    f"""WITH {ORDERS}, h AS (SELECT k, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' AND v >= 300000 THEN 3 WHEN o_orderpriority NOT LIKE '%-%' AND v BETWEEN 100000 AND 200000 THEN 4
    WHEN regexp_matches(o_orderpriority, '^[45]') AND v <= 50000 THEN 5 WHEN o_custkey IN (1, 2, 3) THEN 7 WHEN v <= 20000 THEN 9 END AS rule_id FROM o) SELECT k, CAST(rule_id AS BIGINT) AS rule_id, CAST(rule_id * 10 AS BIGINT) AS account_id FROM h""",
)
def j09(spark, d):
    rows = orders(spark, d).select("k", "v", "o_orderpriority", "o_custkey")
    return suggest.strict_match(rows, _MODEL_RULES, ["o_orderpriority"], "v", "o_custkey").select("k", "rule_id", "account_id")


@query("p08_strict_predicates", f"WITH {ORDERS} SELECT k, lower(o_orderpriority) LIKE '%low%' OR lower(o_orderstatus) LIKE '%low%' AS any_contains, lower(o_orderpriority) NOT LIKE '%f%' AND lower(o_orderstatus) NOT LIKE '%f%' AS none_contains, v BETWEEN 1000 AND 90000 AS between_, false AS unknown FROM o")
def p08(spark, d):
    texts, made = ["o_orderpriority", "o_orderstatus"], {}
    for name, r in {"any_contains": suggest.ModelRule(1, 1, label="contains", label_value="LOW"), "none_contains": suggest.ModelRule(1, 1, label="not_contains", label_value="f"), "between_": suggest.ModelRule(1, 1, amount="between", low=90000, high=1000), "unknown": suggest.ModelRule(1, 1, amount="about", low=1)}.items():
        made[name] = r
    rows = orders(spark, d).select("k", "v", *texts)
    for name, r in made.items():
        rows = suggest.strict_match(rows, [r], texts, "v").withColumn(name, F.col("rule_id").isNotNull()).drop("rule_id", "account_id")
    return rows.select("k", *made)


@query("p09_rule_import", "SELECT * FROM (VALUES (1, 'statement_text.contains=a', ''), (2, '', ''), (3, 'statement_text.contains=Urgent;amount.gte=300000', ''), (4, 'statement_text.not_contains=-;amount.between=-200000..100000', ''), (5, 'statement_text.regex=^[45];amount.lte=50000', ''), (6, '', 'label operator'), (7, '', 'partners'), (8, '', ''), (9, '', '')) v(rule_id, conditions, warnings)")
def p09(spark, d):
    made = [suggest.imported(r) for r in _MODEL_RULES]
    return spark.createDataFrame([(r.rule_id, ";".join(c), ",".join(w)) for r, (c, w) in zip(_MODEL_RULES, made)], "rule_id int, conditions string, warnings string")


_RULE_ROWS = "r AS (SELECT p_partkey AS rule_id, p_size % 3 <> 0 AS enabled, CASE WHEN p_partkey % 2 = 0 THEN p_size % 4 END AS journal_id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 3 END AS company_id FROM part)"


def _rule_rows(spark, d):
    k = F.col("p_partkey")
    return t.table(spark, d, "part").select(k.alias("rule_id"), (F.col("p_size") % 3 != 0).alias("enabled"), F.when(k % 2 == 0, F.col("p_size") % 4).alias("journal_id"), F.when(k % 5 != 0, k % 3).alias("company_id"))


@query("p11_active_rules", f"WITH {_RULE_ROWS} SELECT rule_id FROM r WHERE enabled AND (journal_id IS NULL OR journal_id = 1) AND (company_id IS NULL OR company_id = 2)")
def p11(spark, d):
    return drafts.active_rules(_rule_rows(spark, d), 1, 2).select("rule_id")


@query("s26_rules_with_versions", f"WITH {_RULE_ROWS}, {t.VERSIONS_SQL} SELECT r.rule_id, max(version_number) AS version_number FROM r JOIN versions v ON v.rule_id = r.rule_id WHERE enabled AND approval_status = 'approved' GROUP BY r.rule_id ORDER BY r.rule_id LIMIT 500")
def s26(spark, d):
    latest = rules.latest_approved(t.versions(spark, d)).select("rule_id", "version_number")
    return _rule_rows(spark, d).where("enabled").select("rule_id").join(latest, "rule_id").orderBy("rule_id").limit(500)  # what a prompt may hold


@query("p34_draft_gate", f"WITH {t.VERSIONS_SQL} SELECT o_orderkey AS rule_id, NOT coalesce(bool_or(approval_status = 'draft'), false) AS allowed, CASE WHEN NOT coalesce(bool_or(approval_status = 'draft'), false) THEN CAST(coalesce(max(version_number), 0) + 1 AS BIGINT) END AS version FROM orders LEFT JOIN versions v ON v.rule_id = o_orderkey GROUP BY o_orderkey")
def p34(spark, d):
    return drafts.open_drafts(t.table(spark, d, "orders").select(F.col("o_orderkey").alias("rule_id")), t.versions(spark, d))


# --- catalogs --------------------------------------------------------------------------------------------------------------------


@query("s14_catalog_scan", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey IN (1, 2) AND n_name LIKE '%1%'")
def s14(spark, d):
    where = lookup.domain([("n_regionkey", "in", [1, 2]), ("n_name", "ilike", "1")])
    return t.table(spark, d, "nation").where(where).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


@query("s16_keyset_export", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 1000 AND o_orderstatus = 'F'")
def s16(spark, d):
    return t.table(spark, d, "orders").where("o_orderkey > 1000 AND o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s17_partner_directory", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 5000")
def s17(spark, d):
    return t.table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name").orderBy("c_name", "c_custkey").limit(5000)  # the directory's size


@query("s18_id_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def s18(spark, d):
    wanted = t.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return lookup.split_by_presence(t.table(spark, d, "customer").select("c_custkey", "c_name"), wanted, "c_custkey")[0]


@query("s19_attachment_bytes", "SELECT item_id, length(text) AS chars, sha256(text) AS sha FROM benchmark")
def s19(spark, d):
    raw = F.unbase64(F.base64(F.encode("text", "UTF-8")))
    return t.table(spark, d, "benchmark").select("item_id", F.length(F.decode(raw, "UTF-8")).alias("chars"), F.sha2(raw, 256).alias("sha"))


@query("s20_schema_version", "SELECT c_custkey AS id, [c_nationkey % 3] AS company_ids, c_custkey % 4 = 0 AS deprecated FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN [] ELSE [c_nationkey % 3] END, c_custkey % 4 = 0 FROM customer WHERE c_custkey % 2 = 0")
def s20(spark, d):
    k, c = F.col("c_custkey"), (F.col("c_nationkey") % 3).cast("int")
    rows = t.table(spark, d, "customer")
    new = rows.where(k % 2 == 1).select(k.alias("id"), F.array(c).alias("company_ids"), (k % 4 != 0).alias("active"))
    old = rows.where(k % 2 == 0).select(k.alias("id"), F.when(c != 0, c).alias("company_id"), (k % 4 == 0).alias("deprecated"))
    return lookup.as_current(new).unionByName(lookup.as_current(old))


@query("s24_feature_store", "SELECT d.doc_id, b.doc_id AS item_id FROM documents d JOIN documents b ON sha256(b.text) = sha256(d.text) AND b.doc_id % 10 = 0 WHERE d.doc_id % 10 > 0")
def s24(spark, d):
    """Documents whose bytes a store of a tenth of them has."""
    sha = F.sha2(F.encode("text", "UTF-8"), 256).alias("sha")
    docs = t.table(spark, d, "documents").where("text IS NOT NULL")
    store = docs.where("doc_id % 10 = 0").select(sha, F.col("doc_id").alias("item_id"))
    return docs.where("doc_id % 10 > 0").select("doc_id", sha).join(store, "sha").select("doc_id", "item_id")


@query("s25_editor_catalog", "SELECT c_custkey, c_name, company_id FROM (SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey % 3 END AS company_id FROM customer) WHERE company_id = 1 AND c_acctbal > 0")
def s25(spark, d):
    k = F.col("c_custkey")
    rows = t.table(spark, d, "customer").withColumn("company_id", F.when(k % 4 != 0, F.col("c_nationkey") % 3))
    return review.in_scope(rows, 1).where("company_id IS NOT NULL AND c_acctbal > 0").select("c_custkey", "c_name", "company_id").orderBy("c_name")


@query("p18_catalog_search", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def p18(spark, d):
    return drafts.search_catalog(t.table(spark, d, "part"), " RING ", ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query("p19_partner_list", "SELECT c_custkey FROM (SELECT c_custkey, c_custkey % 3 AS customer_rank, c_custkey % 5 AS supplier_rank, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey % 3 END AS company_id FROM customer) WHERE (customer_rank > 0 OR supplier_rank > 0) AND (company_id IS NULL OR company_id = 1)")
def p19(spark, d):
    k = F.col("c_custkey")
    rows = t.table(spark, d, "customer").select(k, (k % 3).alias("customer_rank"), (k % 5).alias("supplier_rank"), F.when(k % 4 != 0, F.col("c_nationkey") % 3).alias("company_id"))
    return review.in_scope(rows.where("customer_rank > 0 OR supplier_rank > 0"), 1).select("c_custkey")


@query("t06_paged_list", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200 OFFSET 100")
def t06(spark, d):
    return lookup.page(t.table(spark, d, "events"), 100, 100_000, 200, F.desc("ts"), F.desc("event_id")).select("event_id")


@query("t07_candidate_lines", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank FROM orders QUALIFY rank <= 5")
def t07(spark, d):
    return lookup.top_by(t.table(spark, d, "orders"), ["o_custkey"], 5, F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "rank")


@query("u02_union_results", "SELECT o_orderkey FROM orders WHERE o_totalprice > 400000 UNION SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT o_orderkey FROM orders WHERE o_custkey = 7")
def u02(spark, d):
    o = t.table(spark, d, "orders")
    parts = [o.where(c).select("o_orderkey") for c in ("o_totalprice > 400000", "o_orderpriority LIKE '1%'", "o_custkey = 7")]
    return lookup.union_by_key(parts, "o_orderkey")


@query("k01_run_audit", f"WITH {ORDERS} SELECT o_orderstatus AS run, count(*) AS rows, CAST(sum(v) AS DECIMAL(28, 2)) AS total, CASE WHEN sum(v) > 0 THEN 'success' ELSE 'failure' END AS status FROM o GROUP BY o_orderstatus")
def k01(spark, d):
    return lookup.run_audit(orders(spark, d), "o_orderstatus", "v")


@query("k04_catalog_counts", "SELECT 'customer' AS catalog, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def k04(spark, d):
    return lookup.catalog_counts({name: t.table(spark, d, name) for name in ("customer", "supplier", "part")})


@query("k05_dataset_manifest", "SELECT lang AS part, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY lang")
def k05(spark, d):
    return lookup.manifest(t.table(spark, d, "documents"), "lang", "doc_id", "text")


# --- texts, amounts and dates ----------------------------------------------------------------------------------------------------


@query("f01_western_digits", f"WITH {ORDERS} SELECT k, CAST(v AS VARCHAR) AS plain FROM o")
def f01(spark, d):
    eastern = F.translate(F.col("v").cast("string"), "0123456789.", "٠١٢٣٤٥٦٧٨٩٫")
    return orders(spark, d).select("k", money.western_digits(eastern).alias("plain"))


@query("f03_money_text", f"WITH {ORDERS} SELECT k, CASE k % 3 WHEN 0 THEN NULL ELSE CAST(v AS VARCHAR) END AS money FROM o")
def f03(spark, d):
    v = F.col("v").cast("string")
    given = F.when(F.col("k") % 3 == 0, "1e999x").when(F.col("k") % 3 == 1, F.format_number("v", 2)).otherwise(F.concat(v, F.lit("001")))
    return orders(spark, d).select("k", money.money_text(money.to_money(given)).alias("money"))


@query("f05_written_dates", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders")
def f05(spark, d):
    day = F.col("o_orderdate")
    given = F.when(F.col("k") % 4 == 0, F.date_format(day, "d MMMM yyyy")).when(F.col("k") % 4 == 1, F.date_format(day, "dd/MM/yyyy")).when(F.col("k") % 4 == 2, F.date_format(day, "yyyy/M/d")).otherwise("soon")
    return orders(spark, d).select("k", text.written_date(given).alias("date"))


@query(
    "f07_amount_score",
    f"WITH {ORDERS}, p AS (SELECT k, CAST(v AS DOUBLE) AS m, CAST(CAST(v * CAST(1 - (k % 13) * 0.01 AS DECIMAL(4, 2)) AS DECIMAL(20, 2)) AS DOUBLE) AS a FROM o) SELECT k, CASE WHEN a = 0 AND m = 0 THEN 1 WHEN a = 0 OR m = 0 THEN 0 WHEN abs(a - m) <= greatest(1.0, m * 0.01) THEN 1 WHEN a / m >= 0.99 THEN 0.95 WHEN a / m >= 0.97 THEN 0.85 WHEN a / m >= 0.95 THEN 0.75 WHEN a / m >= 0.90 THEN 0.55 ELSE 0 END::DOUBLE AS score FROM p",
)
def f07(spark, d):
    a = (F.col("v") * (F.lit(1) - (F.col("k") % 13) * 0.01).cast("decimal(4,2)")).cast(MONEY)
    return orders(spark, d).select("k", scores.amount_score(a, F.col("v")).alias("score"))


@query("f08_date_score", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 12 = 0 THEN 1 WHEN o_orderkey % 12 <= 1 THEN 0.85 WHEN o_orderkey % 12 <= 3 THEN 0.65 WHEN o_orderkey % 12 <= 7 THEN 0.35 ELSE 0 END::DOUBLE AS score FROM orders")
def f08(spark, d):
    day = F.to_date("o_orderdate")
    return orders(spark, d).select("k", scores.date_score(day, F.expr("date_add(CAST(o_orderdate AS DATE), CAST(k % 12 AS INT))")).alias("score"))


@query(
    "f09_reference_score",
    "WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t, lower(p_brand || '/' || p_type) AS r, lower(p_type) AS y FROM part) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::DOUBLE AS score FROM p",
)
def f09(spark, d):
    body = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    wanted = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("zz-top/9999")
    return t.table(spark, d, "part").select("p_partkey", scores.reference_score(body, wanted, F.lit("")).alias("score"))


@query("f11_partner_score", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0 END::DOUBLE AS score FROM part")
def f11(spark, d):
    first = F.regexp_extract("p_name", r"(\w+)", 1)
    partner = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat(first, F.lit(" zzzz"))).otherwise("zzzz")
    return t.table(spark, d, "part").select("p_partkey", scores.partner_score(F.lower("p_name"), partner).alias("score"))


@query("f10_description_score")
def f10(spark, d):
    """o_orderkey and the score of every hundredth order's document against the move of the order itself and of the next one asked for."""
    k = F.col("o_orderkey")
    o = t.table(spark, d, "orders").where("o_orderkey % 100 = 0").select(k, F.concat_ws(" ", F.lit("Invoice of order"), k.cast("string"), F.lit("for customer"), F.col("o_custkey").cast("string"), F.lit(", "), "o_orderpriority").alias("document"))
    moves = t.table(spark, d, "orders").where("o_orderkey % 100 = 0").select(k.alias("m_id"), F.concat(F.lit("SO/"), k.cast("string")).alias("name"), F.concat_ws(" ", F.lit("customer"), F.col("o_custkey").cast("string")).alias("ref"), F.col("o_orderpriority").alias("journal"))
    pairs = o.withColumn("m_id", F.explode(F.array(k, k + 100))).join(moves, "m_id")
    return pairs.select("o_orderkey", "m_id", F.round(scores.description_score(F.col("document"), F.col("name"), F.col("ref"), F.col("journal")), 6).alias("score"))


@query("f12_confidence_label", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 85 THEN 'high' WHEN l_quantity * 2 >= 65 THEN 'medium' WHEN l_quantity * 2 >= 45 THEN 'low' ELSE 'weak' END AS label FROM lineitem")
def f12(spark, d):
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scores.confidence_label(F.col("l_quantity") * 2).alias("label"))


@query("f18_normalize", "SELECT p_partkey, ['اعمال شركه ' || lower(p_name), lower(p_brand) || ' 12/3', lower(p_type)][p_partkey % 3 + 1] AS folded FROM part")
def f18(spark, d):
    k = F.col("p_partkey")
    given = F.when(k % 3 == 0, F.concat(F.lit("أعْمال  شركة "), F.upper("p_name"))).when(k % 3 == 1, F.concat(F.col("p_brand"), F.lit(" ,١٢/٣"))).otherwise(F.concat(F.lit(" «"), F.col("p_type"), F.lit("» ")))
    return t.table(spark, d, "part").select("p_partkey", text.normalize(given).alias("folded"))


@query("f19_transliterate", "SELECT p_partkey, ['khald', 'shrka nwr', 'mhmd'][p_partkey % 3 + 1] AS latin, ['xld', 'srknr', 'mhmd'][p_partkey % 3 + 1] AS strict FROM part")
def f19(spark, d):
    given = pick(F.col("p_partkey"), "خالد", "شركا  نور", "محمد")
    return t.table(spark, d, "part").select("p_partkey", names.latin(given).alias("latin"), names.skeleton(given).alias("strict"))


@query("f20_spans", "WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w FROM part) SELECT p_partkey, array_to_string(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), '|') AS spans FROM w")
def f20(spark, d):
    return t.table(spark, d, "part").select("p_partkey", F.array_join(names.spans(F.col("p_name"), 2), "|").alias("spans"))


@query("f23_financial_signals", f"WITH {ORDERS} SELECT k, '15.00|' || CAST(v AS VARCHAR) AS amounts, strftime(o_orderdate, '%Y-%m-%d') AS dates, 'INV-' || k || '1' AS references_, 'Acme ' || k AS party FROM o WHERE k >= 0")
def f23(spark, d):
    given = F.concat(F.lit("Supplier: Acme "), F.col("k"), F.lit(", VAT SAR 15 of "), F.format_number("v", 2), F.lit(" ref INV-"), F.col("k"), F.lit("1x"))
    # Digits inside names and dates are amounts too by the pattern; only the parts under test are read here.
    s = text.financial_signals(F.concat(F.lit("VAT SAR 15 of "), F.format_number("v", 2)))
    whole = text.financial_signals(F.concat(given, F.lit(" INV-"), F.col("k"), F.lit("1 on "), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return orders(spark, d).select("k", F.array_join(s["amounts"].cast("array<string>"), "|").alias("amounts"), F.array_join(whole["dates"], "|").alias("dates"), F.array_join(whole["references"], "|").alias("references_"), whole["party"].alias("party"))


@query("f25_entry_references", "SELECT o_orderkey AS k, 'BNK/' || strftime(o_orderdate, '%Y') || '/' || lpad((o_orderkey % 100000000)::VARCHAR, 8, '0') || '|' || lpad((o_orderkey % 100000000)::VARCHAR, 8, '0') AS refs, (o_orderkey % 100000000)::VARCHAR AS ids FROM orders")
def f25(spark, d):
    number = F.lpad((F.col("k") % 100_000_000).cast("string"), 8, "0")
    given = F.concat(F.lit("see bnk / "), F.date_format("o_orderdate", "yyyy"), F.lit("/ "), number, F.lit(" and entry no. "), number, F.lit(", again entry no. "), number)
    refs, ids = text.entry_references(given)
    return orders(spark, d).select("k", F.array_join(refs, "|").alias("refs"), F.array_join(ids.cast("array<string>"), "|").alias("ids"))


@query("f27_cosine", "SELECT a.vec_id, round(greatest(-1, least(1, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))))), 6) AS cosine FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) a JOIN (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def f27(spark, d):
    v = t.table(spark, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


_SAFE = [
    ("'Supplier: Acme ' || k", "'[REDACTED:labeled_party_or_address]'"),
    ("'write to u' || k || '@example.com now'", "'write to [REDACTED:email] now'"),
    ("'iban SA0380000000608010167519; end'", "'iban [REDACTED:iban]; end'"),
    ("'vat 3' || lpad(CAST(k AS STRING), 14, '0') || '.'", "'vat [REDACTED:saudi_vat_number].'"),
    ("'id 1' || lpad(CAST(k AS STRING), 9, '0') || '.'", "'id [REDACTED:saudi_identity].'"),
    ("'call +966 55 123 4567 today'", "'call [REDACTED:phone] today'"),
    ("'see INV-' || k || ' please'", "'see [REDACTED:accounting_reference] please'"),
    ("'SAR 1,500.25 is due'", "'[REDACTED:financial_value] is due'"),
    ("'nothing to hide ' || (k % 10)", "'nothing to hide ' || (k % 10)"),
]


@query("f29_redaction", f"WITH {ORDERS} SELECT k, CASE k % 9 " + " ".join(f"WHEN {i} THEN {want}" for i, (_, want) in enumerate(_SAFE)) + " END AS redacted FROM o")
def f29(spark, d):
    given = F.expr("CASE k % 9 " + " ".join(f"WHEN {i} THEN {made}" for i, (made, _) in enumerate(_SAFE)) + " END")
    return orders(spark, d).select("k", text.redact(given)[0].alias("redacted"))


@query("a23_redaction_counts", "SELECT 'email' AS pattern, CAST(sum(CASE WHEN o_orderkey % 9 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM orders UNION ALL SELECT 'accounting_reference', CAST(sum(CASE WHEN o_orderkey % 9 = 6 THEN 1 ELSE 0 END) AS BIGINT) FROM orders")
def a23(spark, d):
    given = F.expr("CASE k % 9 " + " ".join(f"WHEN {i} THEN {made}" for i, (made, _) in enumerate(_SAFE)) + " END")
    counts = text.redact(given)[1]
    sums = orders(spark, d).agg(*[F.sum(counts[c]).alias(c) for c in ("email", "accounting_reference")])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("pattern"), F.col(c).alias("n")) for c in sums.columns])).alias("x")).select("x.*")


@query("f30_field_redaction", "SELECT c_custkey, '[REDACTED:party]' AS customer_name, '[REDACTED:secret]' AS api_key, '[REDACTED:identifier]' AS email, '[REDACTED:financial_value]' AS balance, c_mktsegment AS segment FROM customer")
def f30(spark, d):
    fields = {"customer_name": F.col("c_name"), "api_key": F.lit("x"), "email": F.lit("y"), "balance": F.col("c_acctbal"), "segment": F.col("c_mktsegment")}
    return t.table(spark, d, "customer").select("c_custkey", *[text.redact_field(n, c).alias(n) for n, c in fields.items()])


@query("f31_canonical_hash", f"WITH {ORDERS} SELECT k, sha256('{{\"account\":' || o_custkey || ',\"amount\":\"' || v || '\",\"id\":' || k || '}}') AS fingerprint FROM o")
def f31(spark, d):
    body = F.to_json(F.struct(F.col("o_custkey").alias("account"), F.col("v").cast("string").alias("amount"), F.col("k").alias("id")))
    return orders(spark, d).select("k", F.sha2(body, 256).alias("fingerprint"))


_MOVES = ("monthly service FEE", "Payroll run", "VAT return", "SADAD bill", "instant payment in", "mada POS settlement", "سداد فاتورة", "hello world", "تحويل محلي")
_MOVE_KINDS = ("bank_fees", "payroll", "general", "bill_payment", "transfer", "pos_settlement", "bill_payment", "general", "transfer")


@query("f33_movement_kind", "SELECT o_orderkey AS k, [" + ", ".join(f"'{x}'" for x in _MOVE_KINDS) + "][o_orderkey % 9 + 1] AS kind FROM orders")
def f33(spark, d):
    return orders(spark, d).select("k", text.movement_kind(pick(F.col("k"), *_MOVES)).alias("kind"))


@query(
    "f34_exception_action",
    f"WITH {ORDERS} SELECT k, CASE k % 4 WHEN 0 THEN 'duplicate_possible' WHEN 1 THEN 'missing_bank_line' WHEN 2 THEN 'needs_review' ELSE 'payroll' END AS action, CASE k % 4 WHEN 0 THEN 0.72 WHEN 1 THEN 0.55 WHEN 2 THEN 0.52 ELSE 0.8 END::DOUBLE AS confidence FROM o",
)
def f34(spark, d):
    k = F.col("k")
    side = F.when(k % 4 == 1, "ledger_only").otherwise("bank_only")
    rows = orders(spark, d).select("k")
    return suggest.exception_action(rows, F.when(k % 4 == 3, "payroll").otherwise("needs_review"), F.when(k % 4 == 3, 0.8).otherwise(0.35), F.when(k % 4 == 0, 0.95), side)


@query("f36_invoice_fields", f"WITH {ORDERS} SELECT k, 'A-' || k AS invoice_number, v AS taxable, CAST(round(v * 0.15, 2) AS DECIMAL(20, 2)) AS vat, CAST(v + round(v * 0.15, 2) AS DECIMAL(20, 2)) AS total FROM o")
def f36(spark, d):
    vat = F.round(F.col("v") * F.lit("0.15").cast("decimal(4,2)"), 2).cast(MONEY)
    given = F.concat(F.lit("Invoice No: A-"), F.col("k"), F.lit("\nSubtotal: "), F.format_number("v", 2), F.lit("\nVAT 15%: "), F.format_number(vat, 2), F.lit("\nGrand total: "), F.format_number((F.col("v") + vat).cast(MONEY), 2))
    return orders(spark, d).withColumn("x", given).select("k", *[c.alias(n) for n, c in documents.invoice_fields(F.col("x")).items()])


@query("f39_lexical_score", "WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS q FROM part) SELECT p_partkey, round(least(1.0, 1.0 * len(list_intersect(list_distinct(q), list_distinct(['ring', 'small', 'c' || p_partkey]))) / len(list_distinct(q))), 6)::DOUBLE AS score FROM p")
def f39(spark, d):
    code = F.concat(F.lit("c"), F.col("p_partkey"))
    return t.table(spark, d, "part").select("p_partkey", F.round(scores.lexical_score(F.lower("p_name"), F.concat(F.lit("ring small "), code), code), 6).alias("score"))


@query("f40_structured_similarity", "WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN 1.0 ELSE 0.0 END AS a, CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN CASE WHEN (p_size % 2 = 0) = (p_size % 5 = 0) THEN 1.0 ELSE 0.0 END END AS b FROM part) SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN 0.5 WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END::DOUBLE AS score FROM p")
def f40(spark, d):
    k = F.col("p_size")
    q = {"move_type": F.when(k % 3 == 0, "unknown").otherwise("entry"), "bank_related": k % 2 == 0}
    e = {"move_type": F.when(k % 3 == 1, "entry").otherwise("refund"), "bank_related": k % 5 == 0}
    return t.table(spark, d, "part").select("p_partkey", scores.structured_similarity(q, e).alias("score"))


@query("f43_document_pair", "SELECT o_orderkey AS k, ['invoice_to_po', 'bank_transaction_to_invoice_or_payment', 'invoice_to_payment_voucher', 'semantic_financial_document_match'][o_orderkey % 4 + 1] AS kind FROM orders")
def f43(spark, d):
    k = F.col("k")
    return orders(spark, d).select("k", scores.document_pair(pick(k, "invoice", "receipt", "payment_voucher", "invoice"), pick(k, "purchase_order", "bank_statement", "vendor_bill", "invoice")).alias("kind"))


@query("f44_draft_accounts", "SELECT o_orderkey AS k, ['Accounts receivable / Bank', 'Bank / Counterparty clearing', 'Fixed asset', 'Expense / Asset clearing'][o_orderkey % 4 + 1] AS debit, ['Revenue', 'Offset account pending review', 'Accounts payable / Bank clearing', 'Accounts payable / Bank clearing'][o_orderkey % 4 + 1] AS credit FROM orders")
def f44(spark, d):
    cats = F.array(pick(F.col("k"), "revenue", "bank_transaction", "asset", "expense"))
    debit, credit = drafts.draft_accounts(cats, F.lit("invoice"))
    return orders(spark, d).select("k", debit.alias("debit"), credit.alias("credit"))


@query("f45_analytic_ids", "SELECT o_orderkey AS k, unnest(CASE WHEN o_custkey % 9 = o_orderkey % 9 THEN [o_custkey % 9] ELSE [o_custkey % 9, o_orderkey % 9] END) AS analytic_id FROM orders")
def f45(spark, d):
    made = F.create_map(F.concat(F.col("o_custkey") % 9, F.lit(", "), F.col("k") % 9, F.lit(",x")), F.lit(100.0))
    ids = F.flatten(F.transform(F.map_keys(made), lambda key: F.transform(F.split(key, ","), lambda p: F.trim(p).try_cast("long"))))
    return orders(spark, d).select("k", F.explode(F.array_distinct(F.filter(ids, lambda i: i.isNotNull()))).alias("analytic_id"))


@query("f46_feature_text", f"WITH {ORDERS} SELECT k, 'ref' || k || ' amount_bucket:' || CASE WHEN v = 0 THEN 'zero' WHEN v < 100 THEN 'lt_100' WHEN v < 1000 THEN '100_999' WHEN v < 10000 THEN '1k_9k' WHEN v < 100000 THEN '10k_99k' WHEN v < 1000000 THEN '100k_999k' ELSE 'gte_1m' END || ' move_type:entry currency:unknown' AS features FROM o")
def f46(spark, d):
    parts = F.array(F.concat(F.lit("REF"), F.col("k")), F.lit(""), F.concat(F.lit("amount_bucket:"), scores.amount_bucket(F.col("v"))), F.lit("move_type:entry"), F.lit("currency:unknown"))
    return orders(spark, d).select("k", text.normalize(F.array_join(F.filter(parts, lambda p: p != ""), " | ")).alias("features"))


@query("f47_statement_like", "SELECT o_orderkey AS k, o_orderkey % 4 IN (0, 1) AS like_ FROM orders")
def f47(spark, d):
    body = pick(F.col("k"), "x", "Opening balance .. Closing balance", "opening balance only", "hello")
    return orders(spark, d).select("k", documents.statement_like(F.when(F.col("k") % 4 == 0, "bank_statement").otherwise("invoice"), body).alias("like_"))


# --- aggregates, votes and searches ------------------------------------------------------------------------------------------------


@query("a07_cross_day", "SELECT l_orderkey AS entry_id, count(DISTINCT CAST(l_shipdate AS DATE)) AS days, bool_or(CAST(l_shipdate AS DATE) <> CAST(o_orderdate AS DATE)) AS cross_day FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey")
def a07(spark, d):
    """Days of an order's lines, and whether any of them is not that of the order."""
    lines = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.to_date("l_shipdate").alias("day"))
    orders = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("entry_id"), F.to_date("o_orderdate").alias("entry_date"))
    return journal.entry_days(lines, orders)


@query("a12_evidence_strength", "SELECT l_orderkey, max(l_discount) AS strength, least(max(CASE WHEN l_linenumber = 1 THEN l_discount END), max(CASE WHEN l_linenumber = 2 THEN l_discount END)) AS weakest FROM lineitem GROUP BY l_orderkey")
def a12(spark, d):
    top = [F.max(F.when(F.col("l_linenumber") == k, F.col("l_discount"))) for k in (1, 2)]
    return t.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("strength"), F.least(*top).alias("weakest"))


@query("a13_weighted_confidence", "SELECT p_partkey, round(greatest(0.15, least(0.97, ((p_size % 10) / 10.0 + 0.5) / 2 - 0.08 * (p_size % 4))), 4)::DOUBLE AS confidence FROM part")
def a13(spark, d):
    agents = F.array((F.col("p_size") % 10) / 10, F.lit(0.5))
    return t.table(spark, d, "part").select("p_partkey", drafts.weighted_confidence(agents, F.col("p_size") % 4).alias("confidence"))


@query("a20_verification_score", "SELECT c_custkey, CAST(round(20.0 * ((c_acctbal > 0)::INT + (c_nationkey > 5)::INT + (c_custkey % 2 = 0)::INT + (c_mktsegment = 'BUILDING')::INT + 1)) AS BIGINT) AS score FROM customer")
def a20(spark, d):
    checks = [F.col("c_acctbal") > 0, F.col("c_nationkey") > 5, F.col("c_custkey") % 2 == 0, F.col("c_mktsegment") == "BUILDING", F.lit(True)]
    return t.table(spark, d, "customer").select("c_custkey", drafts.verification_score(checks).alias("score"))


@query("a21_package_sums", f"WITH {ORDERS} SELECT o_custkey AS package, count(DISTINCT CAST(o_orderdate AS DATE)) AS days, CAST(sum(v) AS DECIMAL(28, 2)) AS total, count(*) AS entries FROM o GROUP BY o_custkey")
def a21(spark, d):
    daily = orders(spark, d).groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.sum("v").alias("total"), F.count("*").alias("entries"))
    return daily.groupBy(F.col("o_custkey").alias("package")).agg(F.count("*").alias("days"), F.sum("total").cast("decimal(28,2)").alias("total"), F.sum("entries").alias("entries"))


_LINES = "SELECT l_orderkey AS query_id, l_partkey AS label, l_discount * 10 AS vote, l_tax * 10 AS lexical, l_linenumber FROM lineitem"


@query(
    "t03_account_candidates",
    """WITH v AS (SELECT l_orderkey AS query_id, l_partkey AS label, round(max(l_discount) * 10, 4) AS vote, round(max(l_tax) * 10, 4) AS lexical FROM lineitem GROUP BY ALL),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vote DESC, label) AS r FROM v QUALIFY r <= 10),
    s AS (SELECT f.*, p_partkey IS NOT NULL AS resolved, round(least(0.995, vote * 0.8 * 0.92 + lexical * 0.08), 4) AS confidence FROM f LEFT JOIN part ON p_partkey = label AND p_partkey % 7 <> 1 WHERE NOT coalesce((SELECT p_size % 5 = 0 FROM part q WHERE q.p_partkey = label AND q.p_partkey % 7 <> 1), false))
    SELECT query_id, label, confidence::DOUBLE AS confidence, resolved, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, vote DESC, label) AS rank FROM s QUALIFY rank <= 5""",
)
def t03(spark, d):
    lines = t.table(spark, d, "lineitem")
    votes = lines.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("label")).agg(F.round(F.max("l_discount") * 10, 4).alias("vote"), F.round(F.max("l_tax") * 10, 4).alias("lexical"))
    accounts = t.table(spark, d, "part").where("p_partkey % 7 != 1").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5 == 0).alias("deprecated"))
    return suggest.best_candidates(votes, accounts, F.lit(0.8))


@query("t04_model_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 5")
def t04(spark, d):
    return lookup.top_by(t.table(spark, d, "lineitem"), ["l_suppkey"], 5, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


_COS100 = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS row_id, round(greatest(0, list_inner_product(q.e, d.e) / (q.n * d.n)), 4) AS score FROM n q JOIN n d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id)"""


def _search(spark, d, k: int, least: float):
    v = t.table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.nearest(asked, v.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector")), k, least)


@query("t02_learner_top_k", f"WITH {_COS100} SELECT query_id, row_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s WHERE score >= 0.2 QUALIFY rank <= 12")
def t02(spark, d):
    return _search(spark, d, 12, 0.2)


@query("t05_ranked_moves", f"WITH {_COS100} SELECT query_id, row_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s QUALIFY rank <= 10")
def t05(spark, d):
    return _search(spark, d, 10, 0.0).select("query_id", "row_id", "rank")


@query(
    "j23_semantic_match",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), v AS (SELECT a.vec_id, a.e AS ae, b.e AS be FROM e a JOIN e b ON b.vec_id = a.vec_id - a.vec_id % 8),
    w AS (SELECT vec_id, list_transform(list_zip(ae, be), lambda p: 0.5 * p[1] + p[2]) AS e FROM v), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM w),
    s AS (SELECT q.vec_id AS query_id, d.vec_id AS row_id, round(greatest(0, list_inner_product(q.e, d.e) / (q.n * d.n)), 4) AS score FROM n q JOIN n d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id)
    SELECT query_id, row_id, score::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM s WHERE score >= 0.62 QUALIFY rank <= 50""",
)
def j23(spark, d):
    """Entries of .62 or more among all, where eight in a row have the same vector behind half of their own."""
    v = t.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    base = v.select(F.col("vec_id").alias("_b"), F.col("e").alias("_e"))
    mixed = v.join(base, F.col("vec_id") - F.col("vec_id") % 8 == F.col("_b")).select(F.col("vec_id").alias("row_id"), F.zip_with("e", "_e", lambda x, y: 0.5 * x + y).alias("vector"))
    return retrieval.nearest(mixed.where("row_id % 100 = 0").withColumnRenamed("row_id", "query_id"), mixed, 50, 0.62)


# --- taxes, drafts and reviews -------------------------------------------------------------------------------------------------------


@query(
    "p14_simple_taxes",
    """WITH x AS (SELECT p_partkey AS tax_id, p_size % 11 <> 0 AS active, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 END AS company_id, CASE WHEN p_partkey % 13 = 0 THEN 'fixed' ELSE 'percent' END AS amount_type, p_size % 6 * 5 AS rate FROM part),
    s AS (SELECT tax_id, d, CASE WHEN tax_id % 5 = 0 AND d = 'invoice' THEN NULL WHEN tax_id % 17 = 0 AND d = 'refund' THEN NULL ELSE tax_id % 100 + CASE WHEN tax_id % 19 = 0 AND d = 'refund' THEN 1 ELSE 0 END END AS a FROM x, (VALUES ('invoice'), ('refund')) v(d)),
    w AS (SELECT tax_id, max(a) FILTER (d = 'invoice') AS i, max(a) FILTER (d = 'refund') AS r FROM s GROUP BY tax_id),
    e AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN company_id = 0 THEN 'company' WHEN amount_type <> 'percent' THEN 'type' WHEN NOT (rate > 0 AND rate < 100) THEN 'rate' WHEN i IS NULL THEN 'invoice' WHEN r IS NULL THEN 'refund' WHEN i <> r THEN 'accounts' END AS error FROM x JOIN w USING (tax_id))
    SELECT tax_id, CASE WHEN error IS NULL THEN i END AS account_id, error FROM e""",
)
def p14(spark, d):
    k = F.col("p_partkey")
    taxes = t.table(spark, d, "part").select(k.alias("tax_id"), (F.col("p_size") % 11 != 0).alias("active"), F.when(k % 3 == 0, k % 2).alias("company_id"), F.when(k % 13 == 0, "fixed").otherwise("percent").alias("amount_type"), (F.col("p_size") % 6 * 5).alias("rate"))
    both = taxes.select("tax_id", F.explode(F.array(F.lit("invoice"), F.lit("refund"))).alias("document"))
    x = F.col("tax_id")
    account = x % 100 + F.when((x % 19 == 0) & (F.col("document") == "refund"), 1).otherwise(0)
    half = (x % 5 == 0) & (F.col("document") == "invoice")
    lines = both.select("tax_id", "document", F.lit("tax").alias("type"), F.when(half, 50.0).otherwise(100.0).alias("factor"), account.alias("account_id")).where(~((x % 17 == 0) & (F.col("document") == "refund")))
    base = both.select("tax_id", "document", F.lit("base").alias("type"), F.lit(100.0).alias("factor"), F.lit(None).cast("long").alias("account_id"))
    return drafts.simple_taxes(taxes, lines.unionByName(base), 1)


_TAXED = f"""{ORDERS}, g AS (SELECT *, CAST(round(v / 1.15, 2) AS DECIMAL(20, 2)) AS b FROM o)"""


def _taxed_lines(spark, d):
    """Three lines an order, spoiled in five ways by its key."""
    k, v = F.col("k"), F.col("v")
    base = F.round(v.cast("decimal(38,12)") / F.lit("1.15").cast("decimal(4,2)"), 2).cast(MONEY)
    zero, none = F.lit(0).cast(MONEY), F.lit(None)

    def line(role: str, debit: Column, credit: Column, **more: Column):
        given = {"account_id": F.lit(5).cast("long"), "tax_id": none.cast("long"), "tax_failed": none.cast("boolean"), "source_amount": v} | more
        return F.struct(F.lit(role).alias("role"), debit.cast(MONEY).alias("debit"), credit.cast(MONEY).alias("credit"), *[c.alias(n) for n, c in given.items()])

    tax = line("tax", v - base + F.when(k % 7 == 4, 1).otherwise(0), zero, tax_id=F.when(k % 7 != 3, F.lit(9)).cast("long"), tax_failed=F.when(k % 7 == 1, True))
    three = F.array(line("bank", zero, v), line("counterpart", base, zero), tax)
    two = F.array(line("bank", zero, v), tax)
    plain = F.array(line("bank", zero, v), line("counterpart", v, zero))
    rows = F.when(k % 7 == 2, two).when(k % 7 == 5, plain).otherwise(three)
    return orders(spark, d).select(k.alias("entry_id"), F.concat(F.lit("t"), k).alias("transaction_key"), F.explode(rows).alias("l")).select("entry_id", "transaction_key", "l.*")


@query("p21_tax_findings", f"WITH {_TAXED} SELECT k AS entry_id, 't' || k AS transaction_key, CASE k % 7 WHEN 1 THEN 'TAX_RESOLUTION_FAILED' WHEN 2 THEN 'INVALID_TAX_LINE_SET' WHEN 3 THEN 'UNRESOLVED_TAX_ACCOUNT' ELSE 'TAX_SPLIT_SOURCE_MISMATCH' END AS code FROM g WHERE k % 7 IN (1, 2, 3, 4)")
def p21(spark, d):
    return drafts.tax_findings(_taxed_lines(spark, d))


@query("p21_folded_lines", f"WITH {_TAXED} SELECT k AS entry_id, 'bank' AS role, CAST(0 AS DECIMAL(20, 2)) AS debit, v AS credit FROM g UNION ALL SELECT k, 'counterpart', CASE WHEN k % 7 IN (0, 5, 6) THEN v ELSE b END, 0 FROM g WHERE k % 7 <> 2 UNION ALL SELECT k, 'tax', CAST(v - b + CASE WHEN k % 7 = 4 THEN 1 ELSE 0 END AS DECIMAL(20, 2)), 0 FROM g WHERE k % 7 IN (1, 2, 3, 4)")
def p21_folded(spark, d):
    lines = _taxed_lines(spark, d)
    return drafts.fold_tax(lines, drafts.tax_findings(lines)).select("entry_id", "role", "debit", "credit")


@query("p16_grid_edits", f"WITH {ORDERS}, c AS (SELECT k % 50 AS row, k, o_orderpriority AS label FROM o) SELECT row, k, CASE WHEN row > 0 AND (lower(label) LIKE '%urgent%' OR CAST(k AS VARCHAR) LIKE '%urgent%') THEN 'edited' ELSE label END AS label FROM c")
def p16(spark, d):
    cells = orders(spark, d).select((F.col("k") % 50).alias("row"), "k", F.col("o_orderpriority").alias("label"))
    return drafts.edit_grid(cells, "label", F.lit("edited"), "Urgent")


@query(
    "p17_proposals",
    f"""WITH {ORDERS}, c AS (SELECT k, abs(v) AS v, k % 5 AS c FROM o WHERE v <> 0 AND k % 5 < 4)
    SELECT k, 1 AS line, ['Bank charges', 'Salaries', 'Accounts payable', 'Bank'][c + 1] AS account, v AS debit, CAST(0 AS DECIMAL(20, 2)) AS credit, 'bank' AS journal FROM c
    UNION ALL SELECT k, 2, ['Bank', 'Bank', 'Bank', 'Accounts receivable'][c + 1], 0, v, 'bank' FROM c""",
)
def p17(spark, d):
    rows = orders(spark, d).select("k", "v", pick(F.col("k"), "bank_charge", "payroll", "supplier_payment", "customer_receipt", "needs_review").alias("category"))
    return drafts.proposals(rows, "k", "category", "v")


@query(
    "p23_enrichment",
    """WITH p AS (SELECT l_orderkey AS k, l_linenumber AS id, l_quantity / 50 AS c FROM lineitem WHERE l_linenumber <= 3), r AS (SELECT k, id, c, row_number() OVER (PARTITION BY k ORDER BY c DESC, id) AS n FROM p),
    b AS (SELECT k, max(id) FILTER (n = 1) AS id, max(c) FILTER (n = 1) AS f, max(c) FILTER (n = 2) AS s FROM r GROUP BY k),
    o2 AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'credit' WHEN 1 THEN 'debit' END AS side FROM orders)
    SELECT o2.k, side, CASE WHEN side IS NOT NULL AND f >= 0.85 AND (s IS NULL OR round(f - s, 6) >= 0.15) THEN id END AS partner_id, CASE WHEN side IS NOT NULL AND o2.k % 3 = 0 THEN 3 END AS analytic_id FROM o2 LEFT JOIN b USING (k)""",
)
def p23(spark, d):
    k = F.col("k")
    cash, other = F.lit("asset_cash"), F.lit("expense")
    one = F.struct(F.lit(3).alias("id"), F.lit(0.9).alias("score"), F.lit(True).alias("resolved"))
    analytics = F.when(k % 3 == 0, F.array(one)).when(k % 3 == 1, F.array(one, one)).otherwise(F.slice(F.array(one), 1, 0))
    rows = orders(spark, d).select("k", F.when(k % 4 == 0, cash).when(k % 4 == 2, cash).otherwise(other).alias("debit_type"), F.when(k % 4 == 1, cash).when(k % 4 == 2, cash).otherwise(other).alias("credit_type"), analytics.alias("analytics"))
    partners = t.table(spark, d, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") / 50).alias("confidence"), F.lit(True).alias("resolved"))
    return drafts.enrich(rows, partners, "k")


@query("p24_draft_validation", "SELECT o_orderkey AS k, ['', 'total', 'id', 'percent'][o_orderkey % 4 + 1] AS error FROM orders")
def p24(spark, d):
    k = F.col("k")
    made = F.when(k % 4 == 0, F.create_map(F.lit("1"), F.lit(60.0), F.lit("2"), F.lit(40.0))).when(k % 4 == 1, F.create_map(F.lit("1"), F.lit(60.0), F.lit("2"), F.lit(39.0))).when(k % 4 == 2, F.create_map(F.lit("x"), F.lit(100.0))).otherwise(F.create_map(F.lit("1"), F.lit(-5.0)))
    return orders(spark, d).select("k", F.coalesce(drafts.analytic_error(made), F.lit("")).alias("error"))


@query("p27_evidence", "SELECT item_id AS evidence_id, ['', 'missing', 'hash_mismatch', 'size_mismatch'][item_id % 4 + 1] AS code FROM benchmark")
def p27(spark, d):
    rows, k = t.table(spark, d, "benchmark"), F.col("item_id")
    body = F.encode("text", "UTF-8")
    sha = F.when(k % 4 == 2, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(body, 256))
    expected = rows.select(k.alias("evidence_id"), sha.alias("sha256"), (F.length(body) + F.when(k % 4 == 3, 1).otherwise(0)).alias("size"))
    actual = rows.where(k % 4 != 1).select(k.alias("evidence_id"), body.alias("content"))
    return drafts.verify_evidence(expected, actual).select("evidence_id", F.coalesce("code", F.lit("")).alias("code"))


@query("p28_claims", "SELECT event_id, event_id % 5 = 0 AS claimed, CASE WHEN event_id % 5 = 0 THEN 'executing' WHEN event_id % 5 = 1 THEN 'done' ELSE 'pending' END AS status FROM events")
def p28(spark, d):
    k = F.col("event_id") % 5
    rows = t.table(spark, d, "events").select(
        "event_id", F.when(k == 1, "done").otherwise("pending").alias("status"), F.sha2(F.when(k == 2, "bad").otherwise("token"), 256).alias("token_hash"), F.sha2("event_type", 256).alias("content_hash"),
        F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, CASE WHEN event_id % 5 = 3 THEN -1 ELSE 60 END)").alias("expires_at"), F.when(k == 4, F.col("ts")).alias("revoked_at"), "event_type", "ts",
    )
    return drafts.claim(rows, F.lit("token"), F.col("event_type"), F.col("ts")).select("event_id", "claimed", "status")


@query("p31_review_defaults", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 7 END AS chosen FROM orders")
def p31(spark, d):
    k = F.col("k")
    made = F.array(*[F.struct(F.lit(i).alias("id"), (k % 3 >= n).alias("selected")) for i, n in ((7, 0), (8, 1), (9, 2))])
    return orders(spark, d).select("k", drafts.only_selected(made).alias("chosen"))


@query("p33_dataset_gates", "SELECT * FROM (VALUES ('size_train', false), ('size_test', true), ('no_missing_split', false), ('balanced', false), ('no_overlap', true)) v(gate, ok)")
def p33(spark, d):
    rows = t.table(spark, d, "documents")
    split = F.when(F.col("doc_id") == 0, F.lit(None)).otherwise(F.lit("train"))
    examples = rows.select(split.alias("split"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha"))
    return drafts.dataset_gates(examples, t.order_lines(spark, d), {"train": -1, "test": 0})


@query("w09_latest_approval", "SELECT o_custkey AS entry_ref, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS approval_id, any_value(c.c_custkey) AS entry_id FROM orders LEFT JOIN customer c ON c_custkey = o_custkey AND c_custkey % 2 = 0 GROUP BY o_custkey")
def w09(spark, d):
    queue = t.table(spark, d, "orders").select(F.col("o_custkey").alias("entry_ref"), F.col("o_orderdate").alias("approved_at"), F.col("o_orderkey").alias("approval_id"))
    entries = t.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("entry_ref"), F.col("c_custkey").alias("entry_id"))
    return drafts.latest_approval(queue, entries).select("entry_ref", "approval_id", "entry_id")


# --- suggestions that need sequence ratios: tested against brute force ------------------------------------------------------------------


def _bank_rows(spark, d):
    said = F.concat(pick(F.col("k"), *_MOVES), F.lit(" "), F.col("o_orderpriority"))
    return orders(spark, d).select("k", said.alias("description"), F.col("v").alias("amount"))


@query("j10_fuzzy_rules")
def j10(spark, d):
    """k, rule_id, account_id, confidence of the best rule for every order's movement."""
    made = [(1, 10, "bank service charges", "fee", None, None, None), (2, 20, "monthly payroll run", "salary", "greater", 1000.0, None), (3, 30, "sadad bill payment", "", "between", 0.0, 200000.0), (4, 40, "pos settlement", "settlement", "lower", None, 100000.0)]
    given = spark.createDataFrame(made, "rule_id long, account_id long, rule_text string, label_value string, mode string, low double, high double")
    return suggest.fuzzy_rule(_bank_rows(spark, d), given, "k")


@query("j11_historical_entries")
def j11(spark, d):
    """k, entry_id, account_id, confidence, needs_review: every hundredth order's movement against all orders but its own."""
    rows = _bank_rows(spark, d)
    past = rows.select(F.col("k").alias("entry_id"), F.lit(1).alias("line_id"), (F.col("k") % 20).alias("account_id"), F.col("description").alias("bank_text"), F.concat(F.lit("line "), F.col("k") % 9).alias("line_text"), F.col("amount").alias("bank_amount"))
    return suggest.historical_entry(rows.where("k % 100 = 0"), past, "k", own=True)


@query("w07_near_duplicates")
def w07(spark, d):
    """k, similarity: orders whose movement's description nearly equals another one's."""
    return suggest.near_duplicates(_bank_rows(spark, d).select("k", "description"), "k", least=0.8)


@query("j04_smart_match")
def j04(spark, d):
    """s_idx, l_idx, confidence: every hundredth vector's movement with at most one other row, each used once."""
    v = t.table(spark, d, "embeddings")
    amount = F.round(F.col("label") * 10).cast(MONEY)
    found = _search(spark, d, 5, 0.0).select(F.col("query_id").alias("s_idx"), F.col("row_id").alias("l_idx"), F.col("score").alias("vector"))
    of = v.select("vec_id", amount.alias("amount"))
    found = found.join(of.select(F.col("vec_id").alias("s_idx"), F.col("amount").alias("s_amount")), "s_idx").join(of.select(F.col("vec_id").alias("l_idx"), F.col("amount").alias("l_amount")), "l_idx")
    return suggest.smart_matches(found)
