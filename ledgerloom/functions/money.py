"""Exact money: DECIMAL(20, 2), rounded half up, never a float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(20, 2)
WIDE = T.DecimalType(38, 12)
MAX_MONEY = "999999999999999999.99"

# Arabic-Indic and Persian digits and separators, and what they become.
EASTERN = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٬،٫"
WESTERN = "01234567890123456789,,."


def western_digits(text: Column) -> Column:
    """Arabic-Indic and Persian digits and separators as Western ones; null as the empty string."""
    return F.translate(F.coalesce(text, F.lit("")), EASTERN, WESTERN)


def to_money(text: Column) -> Column:
    """A plain decimal text (thousands commas allowed) as money; null for empty, not finite, or too large."""
    plain = F.regexp_replace(F.trim(text.cast("string")), ",", "")
    # More integer digits than money has make the cast null, as does any text that is no number.
    return F.round(F.when(plain.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), plain).try_cast(WIDE), 2).try_cast(MONEY)


def parse_number(text: Column) -> Column:
    """An amount as statements print it: currency marks dropped, parentheses negative; null if there is no number."""
    raw = F.trim(western_digits(text))
    return number_of(raw, digits_of(raw))


def digits_of(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^0-9.\-]", "")


def number_of(raw: Column, plain: Column) -> Column:
    """``parse_number`` from a trimmed text in Western digits and its ``digits_of``: where rows are many, both are columns of their own, so that each is made once."""
    negative = raw.startswith("(") & raw.endswith(")")
    value = to_money(plain)
    value = F.when(negative, -value).otherwise(value)
    zero = raw.isin(".", ".0", ".00")
    return F.when(zero, F.lit(0).cast(MONEY)).when(plain.isin("", "-", ".", "-."), F.lit(None).cast(MONEY)).otherwise(value).cast(MONEY)


def money_text(amount: Column) -> Column:
    """Fixed-scale text, as hashes and idempotency keys use it."""
    return amount.cast(MONEY).cast("string")


def tax_split(gross: Column, rate: Column) -> tuple[Column, Column]:
    """Base and tax of a tax-inclusive amount: base half up, tax the rest; null unless 0 < rate < 100 and the tax is positive."""
    size = F.abs(gross.cast(MONEY))
    base = F.round(size.cast(WIDE) * 100 / (F.lit(100).cast("decimal(9,4)") + rate.cast("decimal(9,4)")), 2).cast(MONEY)
    tax = (size - base).cast(MONEY)
    ok = (rate > 0) & (rate < 100) & (tax > 0)
    return F.when(ok, base), F.when(ok, tax)
