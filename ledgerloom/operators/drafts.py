"""Drafts before they are posted: taxes, proposals, enrichment, validation, evidence, claims and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lookup import first_by


def simple_taxes(taxes: DataFrame, repartition: DataFrame, company: int | None = None) -> DataFrame:
    """tax_id, account_id, error: a percentage tax whose invoice and refund lines each post 100 % to one and the same account.

    ``taxes``: tax_id, active, company_id, amount_type, rate. ``repartition``: tax_id, document ('invoice', 'refund'), type, factor,
    account_id. Errors in the order in which they are found: inactive, company, type, rate, invoice, refund, accounts.
    """
    lines = repartition.where("type = 'tax' AND account_id IS NOT NULL AND factor > 0")
    sums = lines.groupBy("tax_id", "document").agg(F.countDistinct("account_id").alias("n"), F.sum("factor").alias("f"), F.min("account_id").alias("a"))
    simple = F.when((F.col("n") == 1) & (F.abs(F.col("f") - 100) <= 0.01), F.col("a"))
    wide = sums.groupBy("tax_id").agg(*[F.max(F.when(F.col("document") == d, simple)).alias(d) for d in ("invoice", "refund")])
    rows = taxes.join(wide, "tax_id", "left")
    elsewhere = F.lit(False) if company is None else F.coalesce(F.col("company_id") != company, F.lit(False))
    error = (
        F.when(~F.coalesce("active", F.lit(True)), "inactive")
        .when(elsewhere, "company")
        .when(F.coalesce("amount_type", F.lit("")) != "percent", "type")
        .when(~F.coalesce((F.col("rate") > 0) & (F.col("rate") < 100), F.lit(False)), "rate")
        .when(F.col("invoice").isNull(), "invoice")
        .when(F.col("refund").isNull(), "refund")
        .when(F.col("invoice") != F.col("refund"), "accounts")
    )
    return rows.select("tax_id", F.when(error.isNull(), F.col("invoice")).alias("account_id"), error.alias("error"))


def tax_findings(lines: DataFrame, entry: str = "entry_id", transaction: str = "transaction_key") -> DataFrame:
    """entry, transaction, code: what is wrong with the tax lines of each transaction; the first code only.

    ``lines`` has role, debit, credit, source_amount, account_id, tax_id, tax_failed. A taxed transaction has one bank, one
    counterpart and one tax line, and base + tax = bank = source.
    """
    def of(role: str, value: Column) -> Column:
        return F.max(F.when(F.col("role") == role, value))

    moved = F.col("debit") + F.col("credit")
    sums = lines.groupBy(entry, transaction).agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("bank", "counterpart", "tax")],
        F.bool_or(F.coalesce("tax_failed", F.lit(False))).alias("failed"),
        of("tax", F.when(F.col("account_id").isNotNull() & F.col("tax_id").isNotNull(), 1)).alias("resolved"),
        of("bank", moved).alias("bank"),
        of("counterpart", moved).alias("base"),
        of("tax", moved).alias("tax"),
        of("counterpart", F.abs("source_amount")).alias("source"),
    )
    three = (F.col("n") == 3) & (F.col("n_bank") == 1) & (F.col("n_counterpart") == 1) & (F.col("n_tax") == 1)
    agrees = (F.col("source") == F.col("bank")) & (F.col("source") == F.col("base") + F.col("tax"))
    code = (
        F.when(F.col("failed"), "TAX_RESOLUTION_FAILED")
        .when(F.col("n_tax") == 0, F.lit(None))
        .when(~three, "INVALID_TAX_LINE_SET")
        .when(F.col("resolved").isNull(), "UNRESOLVED_TAX_ACCOUNT")
        .when(F.col("source").isNull() | F.col("bank").isNull() | F.col("base").isNull() | F.col("tax").isNull(), "INVALID_TAX_SPLIT_AMOUNT")
        .when(~agrees, "TAX_SPLIT_SOURCE_MISMATCH")
    )
    return sums.select(entry, transaction, code.alias("code")).where("code IS NOT NULL")


def fold_tax(lines: DataFrame, findings: DataFrame, entry: str = "entry_id", transaction: str = "transaction_key") -> DataFrame:
    """``lines`` with the tax line of sound transactions added to their counterpart, so that the plain audit can judge them."""
    bad = findings.select(entry, transaction, F.lit(True).alias("_bad"))
    tax = lines.where("role = 'tax'").groupBy(entry, transaction).agg(F.sum("debit").alias("_d"), F.sum("credit").alias("_c"))
    rows = lines.join(bad, [entry, transaction], "left").join(tax, [entry, transaction], "left")
    folds = F.col("_bad").isNull() & (F.col("role") == "counterpart") & F.col("_d").isNotNull()
    out = rows.where(F.col("_bad").isNotNull() | (F.col("role") != "tax"))
    sides = {s: F.when(folds, F.col(s) + F.col(f"_{s[0]}")).otherwise(F.col(s)).cast(dict(lines.dtypes)[s]) for s in ("debit", "credit")}
    return out.withColumns(sides).select(*lines.columns)


def counterpart_side(debit_type: Column, credit_type: Column) -> Column:
    """The side that is not the bank's: 'credit' if only the debit account holds cash, 'debit' if only the credit account does, else null."""
    d, c = (F.coalesce(t, F.lit("")) == "asset_cash" for t in (debit_type, credit_type))
    return F.when(d & ~c, "credit").when(c & ~d, "debit")


def enrich(rows: DataFrame, partners: DataFrame, key: str, least: float = 0.85, margin: float = 0.15, analytic_least: float = 0.7) -> DataFrame:
    """key, side, partner_id, analytic_id: what may be filled in by itself.

    ``rows``: key, debit_type, credit_type, analytics (array of struct id, score, resolved). ``partners``: key, id, confidence,
    resolved. The best partner has to reach ``least`` and lead by ``margin``; an analytic account has to be the only one.
    """
    live = partners.where("resolved AND id IS NOT NULL")
    out = rows.join(_two_best(live, key), key, "left").withColumn("side", counterpart_side(F.col("debit_type"), F.col("credit_type")))
    clear = F.coalesce((F.col("_first") >= least) & (F.col("_second").isNull() | (F.round(F.col("_first") - F.col("_second"), 6) >= margin)), F.lit(False))
    one = F.get("analytics", F.lit(0))
    fits = (F.size("analytics") == 1) & one["resolved"] & (one["score"] >= analytic_least)
    return out.select(key, "side", F.when(F.col("side").isNotNull() & clear, F.col("_id")).alias("partner_id"), F.when(F.col("side").isNotNull() & F.coalesce(fits, F.lit(False)), one["id"]).alias("analytic_id"))


def _two_best(rows: DataFrame, key: str) -> DataFrame:
    """key, _id, _first, _second: the best row's id and score, and the next row's score."""
    by = Window.partitionBy(key).orderBy(F.desc("confidence"), "id")
    out = rows.withColumns({"_n": F.row_number().over(by), "_second": F.lead("confidence").over(by)}).where("_n = 1")
    return out.select(key, F.col("id").alias("_id"), F.col("confidence").alias("_first"), "_second")


def analytic_error(distribution: Column) -> Column:
    """Why an analytic distribution (map of id text to percent) is refused: no positive whole id, a percent out of range, or a sum other than 100 within .01; null if it is sound or empty."""
    ids, parts = F.map_keys(distribution), F.map_values(distribution)
    total = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return (
        F.when(distribution.isNull() | (F.size(ids) == 0), F.lit(None).cast("string"))
        .when(F.exists(ids, lambda k: ~k.rlike(r"^[1-9][0-9]*(,[1-9][0-9]*)*$")), "id")
        .when(F.exists(parts, lambda v: (v <= 0) | (v > 100)), "percent")
        .when(F.abs(total - 100) > 0.01, "total")
    )


def verify_evidence(expected: DataFrame, actual: DataFrame, key: str = "evidence_id") -> DataFrame:
    """key, code: 'missing' evidence, 'hash_mismatch' of its content (SHA-256), 'size_mismatch', or null."""
    there = actual.select(key, F.sha2(F.col("content"), 256).alias("_h"), F.length("content").alias("_n"), F.lit(True).alias("_in"))
    code = F.when(F.col("_in").isNull(), "missing").when(F.col("_n") != F.col("size"), "size_mismatch").when(F.col("_h") != F.col("sha256"), "hash_mismatch")
    return expected.join(there, key, "left").select(key, code.alias("code"))


def claim(rows: DataFrame, token: Column, content: Column, now: Column) -> DataFrame:
    """``rows`` with claimed and status: pending rows whose token and content hashes agree and that are neither expired nor revoked are taken."""
    ok = (F.col("status") == "pending") & (F.col("token_hash") == F.sha2(token, 256)) & (F.col("content_hash") == F.sha2(content, 256)) & (F.col("expires_at") > now) & F.col("revoked_at").isNull()
    ok = F.coalesce(ok, F.lit(False))
    return rows.withColumns({"claimed": ok, "status": F.when(ok, "executing").otherwise(F.col("status"))})


def only_selected(candidates: Column) -> Column:
    """The id of the selected candidate if exactly one is selected."""
    chosen = F.filter(candidates, lambda c: F.coalesce(c["selected"], F.lit(False)))
    return F.when(F.size(chosen) == 1, F.get(chosen, F.lit(0))["id"])


def edit_grid(cells: DataFrame, column: str, value: Column, reference: str | None = None) -> DataFrame:
    """``cells`` with ``column`` set in all data rows, or in those of which any cell contains ``reference``."""
    kept = [c for c in cells.columns if c != "row"]
    hit = F.lit(True)
    if reference is not None:
        hit = F.lower(F.concat_ws("\n", *[F.col(c).cast("string") for c in kept])).contains(reference.lower())
    return cells.withColumn(column, F.when((F.col("row") > 0) & hit, value).otherwise(F.col(column)))


# By category the names of the debit and the credit account, and the journal.
PROPOSALS = {
    "bank_charge": ("Bank charges", "Bank", "bank"),
    "payroll": ("Salaries", "Bank", "bank"),
    "supplier_payment": ("Accounts payable", "Bank", "bank"),
    "customer_receipt": ("Bank", "Accounts receivable", "bank"),
}


def proposals(rows: DataFrame, key: str, category: str, amount: str) -> DataFrame:
    """Two balanced lines for each row of a known category and an amount: key, line, account, debit, credit, journal."""
    zero = F.lit(0).cast("decimal(20,2)")
    size = F.abs(F.col(amount)).cast("decimal(20,2)")
    made = [
        F.when(F.col(category) == name, F.array(F.struct(F.lit(1).alias("line"), F.lit(d).alias("account"), size.alias("debit"), zero.alias("credit"), F.lit(j).alias("journal")), F.struct(F.lit(2).alias("line"), F.lit(c).alias("account"), zero.alias("debit"), size.alias("credit"), F.lit(j).alias("journal"))))
        for name, (d, c, j) in PROPOSALS.items()
    ]
    return rows.where(F.col(amount) != 0).select(key, F.explode(F.coalesce(*made)).alias("_l")).select(key, "_l.*")


def draft_accounts(categories: Column, document: Column) -> tuple[Column, Column]:
    """Names of the debit and credit accounts that a draft starts from."""
    revenue, asset = F.array_contains(categories, "revenue"), F.array_contains(categories, "asset")
    bank = F.array_contains(categories, "bank_transaction") | (document == "bank_statement")
    debit = F.when(revenue, "Accounts receivable / Bank").when(bank, "Bank / Counterparty clearing").when(asset, "Fixed asset").otherwise("Expense / Asset clearing")
    credit = F.when(revenue, "Revenue").when(bank, "Offset account pending review").otherwise("Accounts payable / Bank clearing")
    return debit, credit


def weighted_confidence(agents: Column, conflicts: Column) -> Column:
    """Mean of the agents' confidences less .08 a conflict, from .15 to .97."""
    mean = F.aggregate(agents, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(agents), F.lit(1))
    return F.round(F.greatest(F.lit(0.15), F.least(F.lit(0.97), mean - 0.08 * conflicts)), 4)


def verification_score(checks: list[Column]) -> Column:
    """Percent of the checks that hold, rounded."""
    return F.round(100 * sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0)) / len(checks)).cast("long")


def active_rules(rules: DataFrame, journal: int, company: int) -> DataFrame:
    """Enabled rules of a journal and company; a rule without either holds for all."""
    return rules.where(F.col("enabled") & (F.col("journal_id").isNull() | (F.col("journal_id") == journal)) & (F.col("company_id").isNull() | (F.col("company_id") == company)))


def search_catalog(rows: DataFrame, wanted: str, columns: list[str]) -> DataFrame:
    """Rows of which any column contains ``wanted``, regardless of case; an empty text finds all."""
    hit = F.lit(wanted.strip() == "")
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(wanted.strip().lower()), F.lit(False))
    return rows.where(hit)


def open_drafts(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """rule_id, allowed, version: a rule takes a draft only while it has none open; the new version follows the highest one."""
    state = versions.groupBy("rule_id").agg(F.max("version_number").alias("_v"), F.bool_or(F.col("approval_status") == "draft").alias("_open"))
    out = requests.join(state, "rule_id", "left")
    free = ~F.coalesce("_open", F.lit(False))
    return out.select("rule_id", free.alias("allowed"), F.when(free, F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("version"))


def ledger_rows(lines: DataFrame, order: str, name: str = "name", ref: str = "ref") -> DataFrame:
    """row_number (the ``order`` column), description, amount: debit less credit; the description is the name, with the reference if both differ. Malformed or zero lines are left out, their numbers stay."""
    n, r = (F.coalesce(F.col(c), F.lit("")) for c in (name, ref))
    text = F.when((n != "") & (r != "") & (n != r), F.concat(n, F.lit(" - "), r)).when(n != "", n).otherwise(r)
    money = {s: F.col(s).try_cast("decimal(20,2)") for s in ("debit", "credit")}
    rows = lines.withColumns({"_d": money["debit"], "_c": money["credit"]}).where("_d >= 0 AND _c >= 0 AND _d != _c")
    return rows.select(F.col(order).alias("row_number"), text.alias("description"), (F.col("_d") - F.col("_c")).cast("decimal(20,2)").alias("amount"))


def dataset_gates(examples: DataFrame, lines: DataFrame, expected: dict[str, int]) -> DataFrame:
    """One row a gate: gate, ok. Sizes of the splits, no example without one, all entries balanced, no content in two splits."""
    sizes = examples.groupBy("split").agg(F.count("*").alias("n"))
    named = sizes.sparkSession.createDataFrame(list(expected.items()), "split string, want long")
    by_size = named.join(sizes, "split", "left").select(F.concat(F.lit("size_"), "split").alias("gate"), (F.coalesce("n", F.lit(0)) == F.col("want")).alias("ok"))
    missing = examples.agg((F.count_if(F.col("split").isNull()) == 0).alias("ok")).select(F.lit("no_missing_split").alias("gate"), "ok")
    balance = lines.groupBy("entry_id").agg((F.sum("debit") == F.sum("credit")).alias("b")).agg(F.coalesce(F.bool_and("b"), F.lit(True)).alias("ok")).select(F.lit("balanced").alias("gate"), "ok")
    shared = examples.groupBy("sha").agg(F.countDistinct("split").alias("k")).agg((F.count_if(F.col("k") > 1) == 0).alias("ok")).select(F.lit("no_overlap").alias("gate"), "ok")
    return by_size.unionByName(missing).unionByName(balance).unionByName(shared)


def latest_approval(queue: DataFrame, entries: DataFrame, key: str = "entry_ref") -> DataFrame:
    """Approvals with the first matching entry's id: per reference the newest approval and the smallest entry id."""
    newest = first_by(queue, [key], F.desc("approved_at"), F.desc("approval_id"))
    return newest.join(entries.groupBy(key).agg(F.min("entry_id").alias("entry_id")), key, "left")
