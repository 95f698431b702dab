"""What a document is and what it says: class ladder and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import parse_number
from .text import first_rule

# Classes in the order in which they are tried, and their markers.
CLASS_MARKERS = {
    "sadad_receipt": ["سداد", "sadad", "biller id", "payment confirmation", "تأكيد الدفع", "إيصال دفع"],
    "receipt": ["account transaction details receipt", "riyad bank", "riyadh bank", "rajhi bank", "الراجحي", "processing date", "transaction details", "utility bill payment", "residents", "mol,sub", "خدمات المقيمين", "وزارة العمل", "إيصال", "receipt"],
    "payment_voucher": ["payment voucher", "سند صرف", "سند قبض", "payment order", "أمر صرف"],
    "purchase_order": ["purchase order", "أمر شراء", "طلب شراء", "p.o. number", "po number", "order confirmation"],
    "bank_statement": ["bank statement", "كشف حساب", "كشف بنك", "account statement", "statement of account", "opening balance", "closing balance", "الرصيد الافتتاحي", "الرصيد الختامي"],
    "zatca_invoice": ["zatca", "هيئة الزكاة", "الزكاة والضريبة", "tax invoice", "فاتورة ضريبية", "الرقم الضريبي", "tax identification", "qr code", "رمز الاستجابة"],
    "vendor_bill": ["vendor bill", "فاتورة مورد", "فاتورة مشتريات", "supplier invoice", "bill to"],
    "invoice": ["invoice", "فاتورة", "vat", "total amount", "invoice number", "رقم الفاتورة", "المبلغ الإجمالي"],
}


def document_class(text: Column) -> Column:
    """The first class of which a marker occurs, else 'unknown'."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    ladder = []
    for name, markers in CLASS_MARKERS.items():
        hit = F.lit(False)
        for m in markers:
            hit = hit | lower.contains(m)
        ladder.append((name, hit))
    return first_rule(ladder, "unknown")


def labelled_amount(text: Column, *labels: str) -> Column:
    """The first amount that follows one of the labels within twenty characters, null if none does."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(text, rf"(?is){label}[^0-9\n]{{0,20}}([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit("")) for label in labels])
    return F.when(found.isNotNull(), parse_number(found))


def invoice_fields(text: Column) -> dict[str, Column]:
    return {
        "invoice_number": F.nullif(F.regexp_extract(text, r"(?i)invoice\s*(?:number|no\.?|#)\s*[:#]?\s*([A-Za-z0-9][A-Za-z0-9\-/]*)", 1), F.lit("")),
        "taxable": labelled_amount(text, "sub\\s*total", "taxable\\s*amount"),
        "vat": labelled_amount(text, "vat\\s*tax", "vat\\s*(?:15\\s*%)?", "tax\\s*amount"),
        "total": labelled_amount(text, "total\\s*amount", "grand\\s*total"),
    }


def vat_agrees(amounts: Column, rate: str = "0.15") -> Column:
    """The first amount of which the tax or the amount with tax (to two digits) is also among ``amounts``; null if none is."""
    def ok(x: Column) -> Column:
        tax = F.round(x * F.lit(rate).cast("decimal(4,2)"), 2).cast("decimal(20,2)")
        return F.exists(amounts, lambda y: (y == tax) | (y == (x + tax).cast("decimal(20,2)"))) & (x > 0)

    return F.get(F.filter(amounts, ok), F.lit(0))


def statement_like(document: Column, text: Column) -> Column:
    """Whether a document reads as a bank statement: by its class, or by two of the markers."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((lower.contains(m).cast("int") for m in CLASS_MARKERS["bank_statement"]), F.lit(0))
    return (F.lower(document) == "bank_statement") | (hits >= 2)
