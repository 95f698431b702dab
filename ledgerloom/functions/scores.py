"""Similarity and confidence scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import sequence_ratio
from .text import normalize


def steps(value: Column, levels: list[tuple[float, float]], least: float = 0.0) -> Column:
    """The score of the first level (bound, score) that ``value`` reaches."""
    out = F.when(F.lit(False), F.lit(0.0))
    for bound, score in levels:
        out = out.when(value >= bound, F.lit(score))
    return out.otherwise(F.lit(least))


def amount_score(document: Column, move: Column, apart: Column | None = None) -> Column:
    """1 within max(1, 1 %); else by the ratio of the smaller to the larger magnitude. ``apart``: their difference, where it is known more exactly than doubles tell."""
    d, m = F.abs(document.cast("double")), F.abs(move.cast("double"))
    apart = F.abs(d - m) if apart is None else apart
    ratio = F.least(d, m) / F.greatest(d, m)
    graded = steps(ratio, [(0.99, 0.95), (0.97, 0.85), (0.95, 0.75), (0.90, 0.55)])
    return (
        F.when(d.isNull() | m.isNull(), 0.0)
        .when((d == 0) & (m == 0), 1.0)
        .when((d == 0) | (m == 0), 0.0)
        .when(apart <= F.greatest(F.lit(1.0), m * 0.01), 1.0)
        .otherwise(graded)
    )


#: Ratios of two magnitudes, and what a pair is worth from there on.
AMOUNT_STEPS = ((0.995, 1.0), (0.98, 0.82), (0.95, 0.65), (0.90, 0.45))


def amount_similarity(a: Column, b: Column) -> Column:
    """Ratio of magnitudes in steps; 0 if either is 0 or null."""
    x, y = F.abs(F.coalesce(a.cast("double"), F.lit(0.0))), F.abs(F.coalesce(b.cast("double"), F.lit(0.0)))
    return F.when((x == 0) | (y == 0), 0.0).otherwise(steps(F.least(x, y) / F.greatest(x, y), list(AMOUNT_STEPS)))


def date_score(a: Column, b: Column) -> Column:
    """By the days between two dates: 1, .85, .65, .35 at 0, 1, 3, 7."""
    away = F.abs(F.datediff(a, b))
    return F.when(away.isNull(), 0.0).when(away == 0, 1.0).when(away <= 1, 0.85).when(away <= 3, 0.65).when(away <= 7, 0.35).otherwise(0.0)


def share_of_tokens(tokens: Column, text: Column) -> Column:
    """Share of ``tokens`` that occur in ``text``; 0 without tokens."""
    return F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: text.contains(t))) / F.size(tokens)).otherwise(F.lit(0.0))


def reference_score(text: Column, *references: Column) -> Column:
    """Best over the references: 1 if it occurs in the text, else the share of its tokens of four characters or more that do."""
    each = []
    for reference in references:
        norm = F.lower(F.trim(F.coalesce(reference, F.lit(""))))
        tokens = F.filter(F.regexp_extract_all(norm, F.lit(r"([\w\-/]+)"), 1), lambda t: F.length(t) >= 4)
        each.append(F.when(norm == "", 0.0).when(text.contains(norm), 1.0).otherwise(share_of_tokens(tokens, text)))
    return F.greatest(*each) if len(each) > 1 else each[0]


def partner_words(partner: Column) -> Column:
    """The words of three letters or more that ``partner_score`` looks for."""
    return F.filter(F.regexp_extract_all(F.lower(F.trim(F.coalesce(partner, F.lit("")))), F.lit(r"(\w+)"), 1), lambda t: F.length(t) >= 3)


def partner_score(text: Column, partner: Column, words: Column | None = None) -> Column:
    """1 if the partner's name occurs in the text, else the share of its words of three letters or more that do. ``words``: its ``partner_words``, where they are at hand."""
    norm = F.lower(F.trim(F.coalesce(partner, F.lit(""))))
    found = partner_words(partner) if words is None else words
    return F.when((norm == "") | (text == ""), 0.0).when(text.contains(norm), 1.0).otherwise(share_of_tokens(found, text))


#: Characters of a document that its description is compared by.
DESCRIBED = 1200


def description_score(document: Column, *parts: Column) -> Column:
    """The better of two: the share of a move's words of three characters or more that the document has, and the sequence ratio of the document's beginning and the move's
    joined ``parts``; 0 if either is empty. Both are normalised first, null parts left out."""
    doc, move = normalize(document), normalize(F.concat_ws(" ", *parts))
    words = F.filter(F.regexp_extract_all(move, F.lit(r"([\p{L}\p{N}_/\-]+)"), 1), lambda w: F.length(w) >= 3)
    like = sequence_ratio(F.substring(doc, 1, DESCRIBED), move)
    return F.when((doc == "") | (move == ""), 0.0).otherwise(F.greatest(share_of_tokens(words, doc), like))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 85, "high").when(score >= 65, "medium").when(score >= 45, "low").otherwise("weak")


def amount_bucket(amount: Column) -> Column:
    """Magnitude in seven classes; 'unknown' for null."""
    size = F.abs(amount)
    bounds = [(100, "lt_100"), (1_000, "100_999"), (10_000, "1k_9k"), (100_000, "10k_99k"), (1_000_000, "100k_999k")]
    out = F.when(size.isNull(), "unknown").when(size == 0, "zero")
    for bound, name in bounds:
        out = out.when(size < bound, name)
    return out.otherwise("gte_1m")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if their sizes differ or one has no length, within -1 and 1."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0) | norm.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    return F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams of characters; the text itself if it is shorter."""
    size = F.length(text)
    spans = F.transform(F.sequence(F.lit(1), F.greatest(size - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(spans))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of bigram multisets."""
    def pairs(t: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(spans)

    x, y = pairs(a), pairs(b)
    def times(grams: Column, g: Column) -> Column:
        return F.size(F.filter(grams, lambda h: h == g))

    same = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(times(x, g), times(y, g)))
    return F.when(a == b, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * same / (F.size(x) + F.size(y)))


def structured_similarity(query: dict[str, Column], example: dict[str, Column], names: tuple[str, ...] = ("amount_bucket", "move_type", "currency")) -> Column:
    """Share of the features that agree: ``names`` where both are known, all others (booleans) where either holds; .5 if none counts."""
    checks = []
    for key, q in query.items():
        e = example[key]
        if key in names:
            known = (q != "") & (e != "") & (q != "unknown") & (e != "unknown")
            checks.append(F.when(known, (q == e).cast("double")))
        else:
            checks.append(F.when(q | e, (q == e).cast("double")))
    counted = F.filter(F.array(*checks), lambda c: c.isNotNull())
    return F.when(F.size(counted) > 0, F.aggregate(counted, F.lit(0.0), lambda s, c: s + c) / F.size(counted)).otherwise(0.5)


def lexical_score(query: Column, account: Column, code: Column) -> Column:
    """Share of the query's distinct words that the account's text has, .08 more if its code occurs in the query, 1 at most."""
    def words(text: Column) -> Column:
        return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))

    q, a = words(query), words(account)
    bonus = F.when((code != "") & query.contains(code), 0.08).otherwise(0.0)
    return F.when((F.size(q) == 0) | (F.size(a) == 0), 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(q, a)) / F.size(q) + bonus))


def document_pair(a: Column, b: Column) -> Column:
    """What kind of match two document types make."""
    def either(kind: str) -> Column:
        return (a == kind) | (b == kind)

    voucher = either("payment_voucher") & (either("invoice") | either("vendor_bill"))
    return (
        F.when(either("invoice") & either("purchase_order"), "invoice_to_po")
        .when(either("bank_statement"), "bank_transaction_to_invoice_or_payment")
        .when(voucher, "invoice_to_payment_voucher")
        .otherwise("semantic_financial_document_match")
    )


def smart_score(vector: Column, a: Column, b: Column) -> Column:
    """A vector score, raised where the amounts are equal (.99 at most) or within 5 % of the larger of the first and 1 (.95 at most)."""
    near = F.abs(a - b) / F.greatest(F.abs(a), F.lit(1).cast("decimal(20,2)")) < F.lit("0.05").cast("decimal(4,2)")
    return F.when(a == b, F.least(F.lit(0.99), vector * 0.5 + 0.5)).when(near, F.least(F.lit(0.95), vector * 0.6 + 0.35)).otherwise(vector)
