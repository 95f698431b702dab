"""Double entries from bank transactions, and assertions about them.

Nothing here marks an entry as postable: what can't be proven comes out as an unresolved row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import MONEY, money_text, tax_split

LOW_CONFIDENCE = 0.70
SPREAD = 10_000  # rows that one step makes of a count


def transaction_key(date: Column, description: Column, amount: Column, row: Column) -> Column:
    """SHA-256 of the joined canonical texts of a transaction."""
    return F.sha2(F.concat_ws("|", date.cast("string"), F.trim(F.coalesce(description, F.lit(""))), money_text(amount), row.cast("string")), 256)


def entry_lines(resolved: DataFrame, bank_account_id: int, rate: str | None = None, tax_account_id: int | None = None) -> DataFrame:
    """Bank, counterpart and (where ``rate`` gives a tax) tax line of each transaction.

    ``resolved`` has idx, date, description, amount, account_id, rule_id, version_id and confidence. Money in debits the bank.
    An unknown account stays null. The lines of a transaction always balance.
    """
    size = F.abs(F.col("amount").cast(MONEY))
    inflow = F.col("amount") > 0
    zero = F.lit(0).cast(MONEY)
    if rate is not None:
        base, tax = tax_split(F.col("amount"), F.col(rate))
        base, tax = F.coalesce(base, size), tax
    else:
        base, tax = size, F.lit(None).cast(MONEY)

    def line(role: str, account: Column, value: Column, debit: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), account.cast("long").alias("account_id"), F.when(debit, value).otherwise(zero).alias("debit"), F.when(debit, zero).otherwise(value).alias("credit"))

    lines = F.array(
        line("bank", F.lit(bank_account_id), size, inflow),
        line("counterpart", F.col("account_id"), base, ~inflow),
        F.when(tax.isNotNull(), line("tax", F.lit(tax_account_id), tax, ~inflow)),
    )
    key = transaction_key(F.col("date"), F.col("description"), F.col("amount"), F.col("idx"))
    rows = resolved.where("amount IS NOT NULL AND amount != 0").withColumn("transaction_key", key).withColumn("_l", F.explode(F.filter(lines, lambda x: x.isNotNull())))
    evidence = [c for c in ("rule_id", "version_id", "confidence") if c in resolved.columns]
    return rows.select("transaction_key", F.col("idx").alias("source_row"), F.col("date").alias("entry_date"), F.col("amount").alias("source_amount"), "_l.*", *evidence)


def daily_entries(lines: DataFrame) -> DataFrame:
    """One row per date: transactions, lines, totals, unresolved, duplicates, balanced, ready_for_review."""
    keyed = lines.groupBy("entry_date", "transaction_key").agg(
        F.count("*").alias("n"),
        F.sum("debit").alias("d"),
        F.sum("credit").alias("c"),
        F.count_if((F.col("role") == "counterpart") & F.col("account_id").isNull()).alias("u"),
        F.count_if(F.col("role") == "bank").alias("b"),
    )
    day = keyed.groupBy("entry_date").agg(
        F.count("*").alias("transactions"),
        F.sum("n").alias("lines"),
        F.sum("d").cast("decimal(28,2)").alias("total_debit"),
        F.sum("c").cast("decimal(28,2)").alias("total_credit"),
        F.sum("u").alias("unresolved"),
        F.count_if(F.col("b") > 1).alias("duplicates"),
    )
    ok = (F.col("total_debit") == F.col("total_credit")) & (F.col("total_debit") > 0)
    return day.withColumn("balanced", ok).withColumn("ready_for_review", ok & (F.col("unresolved") == 0) & (F.col("duplicates") == 0))


def balance_errors(lines: DataFrame, key: str = "entry_id") -> DataFrame:
    """key, n_lines, total_debit, total_credit, error (null if the entry is balanced): the first of too_few_lines, negative_amount, one_side_only, zero_total, unbalanced."""
    debit, credit = F.coalesce(F.col("debit"), F.lit(0)), F.coalesce(F.col("credit"), F.lit(0))
    sums = lines.groupBy(key).agg(
        F.count("*").alias("n_lines"),
        F.sum(debit).cast("decimal(28,2)").alias("total_debit"),
        F.sum(credit).cast("decimal(28,2)").alias("total_credit"),
        F.count_if((debit < 0) | (credit < 0)).alias("_neg"),
        F.count_if((debit > 0) == (credit > 0)).alias("_side"),
    )
    return sums.select(key, "n_lines", "total_debit", "total_credit", _balance_error("total_debit", "total_credit").alias("error"))


def _balance_error(debit: str, credit: str) -> Column:
    return (
        F.when(F.col("n_lines") < 2, "too_few_lines")
        .when(F.col("_neg") > 0, "negative_amount")
        .when(F.col("_side") > 0, "one_side_only")
        .when(F.col(debit) <= 0, "zero_total")
        .when(F.col(debit) != F.col(credit), "unbalanced")
    )


def entry_days(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """entry_id, days (of its lines, distinct) and cross_day: whether a line's day is not the entry's; null where no two can be compared. Entries without lines are left out.

    ``lines``: entry_id, day; ``entries``: entry_id, entry_date. Lines are sorted once and counted by windows before they meet entries; no table of all days is held in memory.
    If the first and the last day each equal the entry's last and first date, all are one.
    """
    down = Window.partitionBy("entry_id").orderBy("day")
    new = F.coalesce(F.col("day") != F.lag("day").over(down), F.col("day").isNotNull())
    lines = lines.where("entry_id IS NOT NULL").withColumn("_new", new.cast("long"))
    ends = lines.select("entry_id", F.sum("_new").over(down).alias("days"), F.first("day", True).over(down).alias("_first"), F.col("day").alias("_last"), F.lead(F.lit(1)).over(down).isNull().alias("_end"))
    dates = entries.groupBy("entry_id").agg(F.min("entry_date").alias("_low"), F.max("entry_date").alias("_high"))
    return ends.where("_end").join(dates, "entry_id").select("entry_id", "days", ((F.col("_first") != F.col("_high")) | (F.col("_last") != F.col("_low"))).alias("cross_day"))


def role_counts(lines: DataFrame) -> DataFrame:
    """transaction_key, n_lines, n_bank, n_counterpart, n_tax, complete (one bank and one counterpart line, a tax line at most)."""
    n = {r: F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("bank", "counterpart", "tax")}
    out = lines.groupBy("transaction_key").agg(F.count("*").alias("n_lines"), *n.values())
    return out.withColumn("complete", (F.col("n_bank") == 1) & (F.col("n_counterpart") == 1) & (F.col("n_tax") <= 1) & (F.col("n_lines") == F.col("n_bank") + F.col("n_counterpart") + F.col("n_tax")))


def duplicate_sources(lines: DataFrame) -> DataFrame:
    """transaction_key, source_row, n of bank lines that stand more than once."""
    return lines.where("role = 'bank'").groupBy("transaction_key", "source_row").agg(F.count("*").alias("n")).where("n > 1")


def reversed_lines(lines: DataFrame, prefix: str = "Reversal: ") -> DataFrame:
    """Debit and credit swapped, the name prefixed."""
    out = lines.withColumnsRenamed({"debit": "_d", "credit": "_c"}).withColumn("debit", F.col("_c")).withColumn("credit", F.col("_d"))
    if "name" in lines.columns:
        out = out.withColumn("name", F.concat(F.lit(prefix), F.coalesce("name", F.lit(""))))
    return out.select(*lines.columns)


def audit(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """entry_id, severity, code: findings about each entry, and CORE_ASSERTIONS_PASSED where there is none.

    ``entries``: entry_id, entry_date, bank_account_id, total_debit, total_credit, document_id, sha256, hash_verified, entry_hash,
    current_hash. ``lines``: entry_id, transaction_key, source_row, source_date, source_amount, role, account_id, account_code,
    debit, credit, evidence_source, rule_id, version_id, confidence. A transaction without exactly one bank and one counterpart
    line has that finding only.
    """
    pairs = _sums_of_pairs(lines)
    cols = ["entry_id", "entry_date", "bank_account_id", "total_debit", "total_credit", "document_id", "sha256", "hash_verified", "entry_hash", "current_hash"]
    alike = entries.groupBy(*cols).agg(F.count("*").alias("_copies"))
    keyed = F.coalesce("transaction_key", F.lit("")) != ""
    whole = keyed & (F.col("n_lines") == 2) & (F.col("nb") == 1) & (F.col("nc") == 1)
    known = F.col("size").isNotNull() & F.col("bank_value").isNotNull() & F.col("other_value").isNotNull()
    of_pair = {
        "INCOMPLETE_DOUBLE_ENTRY_PAIR": keyed & ~whole,
        "BANK_ACCOUNT_MISMATCH": whole,  # those of another account than the entry's, once that is known
        "UNRESOLVED_COUNTERPART_ACCOUNT": whole & ~F.col("_account"),
        "NO_BANK_RULE_EVIDENCE": whole & ~F.col("_evidence"),
        "INVALID_TRANSACTION_AMOUNT": whole & ~known,
        "SOURCE_AMOUNT_MISMATCH": whole & known & ((F.col("size") <= 0) | (F.col("bank_value") != F.col("size")) | (F.col("other_value") != F.col("size"))),
        "LOW_RULE_CONFIDENCE": whole & (F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE),
    }
    added = ("n_lines", "d", "c", "_neg", "_side")
    # Pairs are counted by the bank's account before they meet entries.
    sums = pairs.withColumn("bank_account", F.when(whole, F.col("bank_account"))).groupBy("entry_id", "bank_account").agg(
        *[F.sum(c).alias(c) for c in added], F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max(~keyed).alias("no_key"), F.max("twice").alias("twice"), *[F.count_if(c).alias(code) for code, c in of_pair.items()]
    )
    expected = F.col("bank_account_id")
    counts = {code: F.col(code) for code in of_pair}
    counts["BANK_ACCOUNT_MISMATCH"] = F.when(expected.isNotNull() & ~F.col("bank_account").eqNullSafe(expected), F.col("BANK_ACCOUNT_MISMATCH"))
    head = alike.join(sums, "entry_id", "left").groupBy(*cols, "_copies").agg(
        *[F.sum(c).alias(c) for c in added],
        F.max((F.col("_first") != F.col("entry_date")) | (F.col("_last") != F.col("entry_date"))).alias("_other_day"),
        F.max("no_key").alias("no_key"),
        F.max("twice").alias("twice"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(code) for code, c in counts.items()],
    )
    head = head.withColumns({"_d": F.col("d").cast("decimal(28,2)"), "_c": F.col("c").cast("decimal(28,2)")})
    same = Window.partitionBy("entry_id")  # an entry that stands there with two dates
    head = head.withColumn("cross_day", F.max("_other_day").over(same)).withColumn("error", _balance_error("_d", "_c"))
    has = F.col("n_lines").isNotNull()
    no_document = F.col("document_id").isNull() | (F.coalesce("sha256", F.lit("")) == "")
    of_entry = {
        "SOURCE_DOCUMENT_MISSING": no_document,
        "SOURCE_HASH_MISMATCH": ~no_document & ~F.coalesce("hash_verified", F.lit(False)),
        "BANK_RULE_DRIFT": (F.col("entry_hash") != "") & (F.col("current_hash") != "") & (F.col("entry_hash") != F.col("current_hash")),
        "NO_JOURNAL_LINES": ~has,
        "UNBALANCED_ENTRY": has & F.col("error").isNotNull(),
        "TOTALS_MISMATCH": has & F.col("error").isNull() & ~(F.col("_d").eqNullSafe(F.col("total_debit")) & F.col("_c").eqNullSafe(F.col("total_credit"))),
        "CROSS_DAY_LINES": F.col("cross_day"),
        "MISSING_TRACE_KEY": F.col("no_key"),
        "DUPLICATE_BANK_TRANSACTION": F.col("twice"),
    }
    head = head.withColumns({code: F.coalesce(c, F.lit(False)).cast("long") for code, c in of_entry.items()})
    codes = [*of_entry, *of_pair]
    head = head.withColumn("_found", sum((F.col(c) for c in codes), F.lit(0))).withColumn("_found", F.sum("_found").over(same))
    passed = F.when(F.col("entry_id").isNull() | (F.col("_found") == 0), 1).otherwise(0).cast("long")
    each = [F.struct(F.lit("warning" if code == "LOW_RULE_CONFIDENCE" else "error").alias("severity"), F.lit(code).alias("code"), (F.col(code) * F.col("_copies")).alias("n")) for code in codes]
    each.append(F.struct(F.lit("info").alias("severity"), F.lit("CORE_ASSERTIONS_PASSED").alias("code"), (passed * F.col("_copies")).alias("n")))
    found = head.select("entry_id", F.explode(F.filter(F.array(*each), lambda x: x["n"] > 0)).alias("_f")).select("entry_id", "_f.*")
    # A row for each of the n, by two short arrays in place of a long one.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SPREAD)))
    found = found.withColumn("_part", part).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(SPREAD).cast("long"), F.col("n") - F.col("_part") * SPREAD))))
    return found.select("entry_id", "severity", "code")


def _sums_of_pairs(lines: DataFrame) -> DataFrame:
    """A row for each entry_id and transaction_key: what ``audit`` asks of its lines, in one pass over them. Numbers and truth values only, so that they are summed by hashing and not by sorting."""
    bank, other = F.col("role") == "bank", F.col("role") == "counterpart"
    debit, credit = F.coalesce(F.col("debit"), F.lit(0)), F.coalesce(F.col("credit"), F.lit(0))
    account = F.col("account_id").isNotNull() & (F.coalesce("account_code", F.lit("")) != "")
    evidence = F.col("evidence_source").eqNullSafe(F.lit("bank_rule")) & F.col("rule_id").isNotNull() & F.col("version_id").isNotNull()
    rows = lines.groupBy("entry_id", "transaction_key", "source_row").agg(
        F.count("*").alias("n_lines"),
        F.count_if(bank).alias("nb"),
        F.count_if(other).alias("nc"),
        F.sum(debit).alias("d"),
        F.sum(credit).alias("c"),
        F.count_if((debit < 0) | (credit < 0)).alias("_neg"),
        F.count_if((debit > 0) == (credit > 0)).alias("_side"),
        F.min("source_date").alias("_first"),
        F.max("source_date").alias("_last"),
        F.max(F.when(bank, F.col("account_id"))).alias("bank_account"),
        F.max(F.when(other, account)).alias("_account"),
        F.max(F.when(other, evidence)).alias("_evidence"),
        F.max(F.when(other, F.col("confidence"))).alias("confidence"),
        F.max(F.when(other, F.col("source_amount"))).alias("size"),
        F.max(F.when(bank, F.col("debit") + F.col("credit"))).alias("bank_value"),
        F.max(F.when(other, F.col("debit") + F.col("credit"))).alias("other_value"),
    )
    whole = ("bank_account", "_account", "_evidence", "confidence", "bank_value", "other_value")
    return rows.groupBy("entry_id", "transaction_key").agg(
        *[F.sum(c).alias(c) for c in ("n_lines", "nb", "nc", "d", "c", "_neg", "_side")],
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.max(F.col("nb") > 1).alias("twice"),
        F.abs(F.max("size")).alias("size"),
        *[F.max(c).alias(c) for c in whole],
    )


def risk(findings: DataFrame) -> DataFrame:
    """entry_id, blocking, warnings, risk_level, recommendation; never safe to post, always for a person to approve."""
    out = findings.groupBy("entry_id").agg(F.count_if(F.col("severity") == "error").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    level = F.when(F.col("blocking") > 0, "high").when(F.col("warnings") > 0, "medium").otherwise("low")
    advice = F.when(F.col("blocking") > 0, "needs_revision").when(F.col("warnings") > 0, "human_review").otherwise("approve")
    return out.select("*", level.alias("risk_level"), advice.alias("recommendation"), F.lit(False).alias("safe_to_post"), F.lit(True).alias("human_approval_required"))
