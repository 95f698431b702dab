"""Names in Arabic and Latin script: pairs by shared keys, 41 measures of a pair, a logistic score with phonetic rules beside it, and its training."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names

FORMS = ("native", "latin", "strict", "relaxed")
#: What is measured of which forms of a name.
MEASURES = {
    "full_ratio": FORMS, "length_ratio": FORMS, "exact": FORMS, "best_span_ratio": FORMS, "exact_span": FORMS, "best_span_length_ratio": FORMS,
    "bigram_jaccard": FORMS, "trigram_jaccard": ("native", "latin"), "prefix_ratio": ("latin", "strict"),
}
FEATURES = (
    *(f"{form}_{measure}" for measure, forms in MEASURES.items() for form in forms),
    "query_in_candidate", "candidate_in_query", "first_strict_char_match", "query_token_count", "candidate_token_count",
    "candidate_is_numeric", "query_has_arabic", "candidate_has_arabic", "both_have_arabic",
)
#: Characters and words of a name that are looked at, and words of a span.
MOST_CHARS, MOST_WORDS, SPAN_WORDS = 4000, 120, 4

_ARABIC = re.compile("[؀-ۿ]")
_WORDS = re.compile("[\\w؀-ۿ]+")
_MARKS = re.compile(names.DIACRITICS + "|ـ")
_FOLDED = str.maketrans("٠١٢٣٤٥٦٧٨٩أإآىة", "0123456789ااايه")
_LATIN = str.maketrans({**names.LATIN, "ء": "a"})
_SOUND = re.compile("|".join(pair for pair, _ in names.SOUNDS))
_SOUND_OF = dict(names.SOUNDS)


def fold(text: str) -> str:
    """Words in lower case without marks, letter forms written as one letter, joined by one space."""
    plain = unicodedata.normalize("NFKD", text[:MOST_CHARS].translate(_FOLDED))
    bare = "".join(c for c in plain if not unicodedata.combining(c)).lower()
    return " ".join(_WORDS.findall(_MARKS.sub("", bare).translate(_FOLDED)))


class Name:
    """A name in its four forms, and those of its spans of one to four words."""

    __slots__ = ("arabic", "forms", "spans", "words")

    def __init__(self, text: str):
        native = fold(text)
        self.arabic = bool(_ARABIC.search(text[:MOST_CHARS]))
        self.words = native.split()
        self.forms = written(native)
        some = self.words[:MOST_WORDS]
        spans = {" ".join(some[i : i + n]) for n in range(1, SPAN_WORDS + 1) for i in range(len(some) - n + 1)}
        self.spans = tuple(sorted({x for x in form if x}) for form in zip(*map(written, spans))) or ((), (), (), ())


@lru_cache(maxsize=1 << 16)
def written(native: str) -> tuple[str, str, str, str]:
    """A folded name as it is, in Latin letters, and its consonants with doubled ones twice and once."""
    latin = " ".join(native.translate(_LATIN).split())
    strict = names.consonants(_SOUND.sub(lambda m: _SOUND_OF[m.group()], latin))
    return native, latin, strict, re.sub(r"(.)\1+", r"\1", strict)


name_of = lru_cache(maxsize=1 << 15)(Name)


@lru_cache(maxsize=1 << 17)
def sequence_ratio(a: str, b: str) -> float:
    """The ratio of two texts; kept, as names share words and spans, and forms of a name are often equal."""
    return SequenceMatcher(None, a, b).ratio()


def ratio(a: str, b: str) -> float:
    return 0.0 if not a or not b else 1.0 if a == b else sequence_ratio(a, b)


def length_ratio(a: str, b: str) -> float:
    small, large = sorted((len(a), len(b)))
    return small / large if small else 0.0


@lru_cache(maxsize=1 << 16)
def ngrams(text: str, n: int) -> frozenset[str]:
    bare = "".join(text.split())
    return frozenset(bare[i : i + n] for i in range(max(1, len(bare) - n + 1))) - {""}


def jaccard(a: str, b: str, n: int) -> float:
    x, y = ngrams(a, n), ngrams(b, n)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x and y else 0.0


def prefix_ratio(a: str, b: str) -> float:
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return same / max(len(a), len(b)) if a and b else 0.0


def best_span(query: str, spans: Iterable[str]) -> tuple[float, float]:
    """The greatest (ratio, length ratio) of the query and a span. Spans that a cheap upper bound rules out are passed over."""
    best = (0.0, 0.0)
    if query in spans and query:
        return 1.0, 1.0
    for span in spans if query else ():
        if 2 * min(len(query), len(span)) >= best[0] * (len(query) + len(span)) * 0.999999:
            best = max(best, (sequence_ratio(query, span), length_ratio(query, span)))
    return best if best[0] > 0 else (0.0, 0.0)


def pair_features(query: str | None, candidate: str | None) -> list[float]:
    """The measures of a pair, each from 0 to 1, in the order of ``FEATURES``; a null name is an empty one."""
    q, c = name_of(query or ""), name_of(candidate or "")
    got: dict[str, float] = {}
    for k, form in enumerate(FORMS):
        a, b = q.forms[k], c.forms[k]
        enough = 2 if form in ("strict", "relaxed") else 1  # a single consonant says little
        near = best_span(a, c.spans[k])
        values = {
            "full_ratio": ratio(a, b), "length_ratio": length_ratio(a, b), "exact": float(len(a) >= enough and a == b), "best_span_ratio": near[0], "exact_span": float(bool(a) and a in c.spans[k]),
            "best_span_length_ratio": near[1], "bigram_jaccard": jaccard(a, b, 2), "trigram_jaccard": jaccard(a, b, 3), "prefix_ratio": prefix_ratio(a, b),
        }
        got |= {f"{form}_{measure}": v for measure, v in values.items() if form in MEASURES[measure]}
    a, b = "".join(q.words), "".join(c.words)
    x, y = q.forms[2], c.forms[2]
    got |= {
        "query_in_candidate": len(a) >= 4 and a in b, "candidate_in_query": len(b) >= 4 and b in a and length_ratio(a, b) >= 0.8, "first_strict_char_match": bool(x) and x[:1] == y[:1],
        "query_token_count": min(len(q.words), 10) / 10, "candidate_token_count": min(len(c.words), 20) / 20, "candidate_is_numeric": b.isdigit(),
        "query_has_arabic": q.arabic, "candidate_has_arabic": c.arabic, "both_have_arabic": q.arabic and c.arabic,
    }
    return [float(got[name]) for name in FEATURES]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features(query: pd.Series, candidate: pd.Series) -> pd.Series:
    """``pair_features`` of each row. Sequence ratios have no built-in function."""
    return pd.Series([pair_features(a, b) for a, b in zip(query, candidate)])


def measured(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``_f``, the measures of _q and _d. Each pair is measured once: taken for deterministic, the function would stand in the plan as often as a measure is read."""
    return pairs.withColumn("_f", features.asNondeterministic()("_q", "_d"))


@dataclass(frozen=True)
class Model:
    """Coefficients by the name of their feature. A score from ``accept`` on is a match, one from ``review`` on is to be looked at."""

    intercept: float
    coefficients: dict[str, float]
    accept: float = 0.80
    review: float = 0.65

    def __post_init__(self):
        if set(self.coefficients) != set(FEATURES):
            raise ValueError("a model has one coefficient for each feature")


@dataclass(frozen=True)
class Rules:
    """What equal consonants are worth, and the least model score with which they count."""

    strict_score: float = 0.96
    strict_floor: float = 0.30
    relaxed_score: float = 0.88
    relaxed_floor: float = 0.55


def value(of: Column, name: str) -> Column:
    return F.get(of, F.lit(FEATURES.index(name)))


def probability(of: Column, model: Model) -> Column:
    """The logistic score of an array of features, as one sum of products."""
    linear = F.lit(model.intercept)
    for name in FEATURES:
        linear = linear + value(of, name) * model.coefficients[name]
    return 1 / (1 + F.exp(-linear))


def decide(of: Column, p: Column, model: Model, rules: Rules = Rules()) -> dict[str, Column]:
    """score, model_score, rule_score, decision (match, review, reject) and reason of an array of features and its ``probability``.

    A rule is worth its score where it holds, and the greater of rule and model counts. A pair with a wordless name is rejected.
    """

    def at_least(**bounds: float) -> Column:
        held = F.lit(True)
        for name, bound in bounds.items():
            held = held & (value(of, name) >= bound)
        return held

    contained = F.greatest(*[value(of, x) for x in ("native_exact_span", "latin_exact_span", "query_in_candidate")]) > 0
    strict = at_least(strict_exact_span=1, latin_best_span_ratio=0.64) & (p >= rules.strict_floor)
    relaxed = at_least(relaxed_exact_span=1, strict_best_span_ratio=0.75, strict_best_span_length_ratio=0.75, latin_best_span_ratio=0.50) & (p >= rules.relaxed_floor)
    ladder = [("exact_span", contained, 1.0), ("strict_phonetic_span", strict, rules.strict_score), ("relaxed_phonetic_span", relaxed, rules.relaxed_score)]
    worded = F.least(value(of, "query_token_count"), value(of, "candidate_token_count")) > 0
    reason, worth = F.when(~worded, "empty_text"), F.when(~worded, 0.0)
    for name, holds, points in ladder:
        reason, worth = reason.when(holds, name), worth.when(holds, points)
    reason, worth = reason.otherwise("logistic_regression"), worth.otherwise(0.0)
    score = F.when(worded, F.greatest(p, worth)).otherwise(0.0)
    decision = F.when(score >= model.accept, "match").when(score >= model.review, "review").otherwise("reject")
    return {"score": score, "model_score": F.when(worded, p).otherwise(0.0), "rule_score": worth, "decision": decision, "reason": reason}


def shape(query: Column, candidate: Column) -> Column:
    """The candidate with its digits numbered in the order in which they come, if it is ASCII and the query has letters only.

    A digit then equals nothing of the query, so that all that counts is which of the candidate's digits are equal: no measure tells a text from its shape.
    """
    digits = F.array_join(F.array_distinct(F.regexp_extract_all(candidate, F.lit("([0-9])"), 1)), "")
    plain = query.rlike("^[A-Za-z\u0621-\u064a ]*$") & candidate.rlike("^[\\x00-\\x7f]*$")
    return F.when(plain, F.call_function("translate", candidate, digits, F.lit("0123456789"))).otherwise(candidate)


def score_pairs(pairs: DataFrame, query: str, candidate: str, model: Model, rules: Rules = Rules()) -> DataFrame:
    """``pairs`` with the columns of ``decide``. The measures are computed once for each text and each ``shape`` of another, however many rows have them."""
    asked, there = (F.coalesce(F.col(c), F.lit("")) for c in (query, candidate))
    keyed = pairs.withColumns({"_q": asked, "_d": shape(asked, there)})
    judged = measured(by_query(keyed.select("_q", "_d"))).withColumn("_m", probability(F.col("_f"), model))
    judged = judged.select("_q", "_d", *[c.alias(name) for name, c in decide(F.col("_f"), F.col("_m"), model, rules).items()])
    return keyed.join(judged, ["_q", "_d"]).drop("_q", "_d")


def keys_of(text: str | None, spans: bool) -> list[str]:
    """What a name is found by: consonants (doubled ones once) of the whole name, which come first, of each word or span, and three letters in a row of its Latin form."""
    name = name_of(text or "")
    if not name.words:
        return []
    latin = "".join(name.forms[1].split())
    sounds = name.spans[3] if spans else sorted({written(w)[3] for w in name.words} - {""})
    grams = [f"g{latin[i : i + 3]}" for i in range(len(latin) - 2)] or [f"t{latin}"]
    return list(dict.fromkeys([f"s{name.forms[3]}", *(f"s{x}" for x in sounds), *grams]))


@F.pandas_udf(T.ArrayType(T.StringType()))
def query_keys(text: pd.Series) -> pd.Series:
    return pd.Series([keys_of(t, False) for t in text])


def latin_name(text: str | None) -> str:
    return name_of(text or "").forms[1]


@F.pandas_udf(T.StringType())
def latin_of(text: pd.Series) -> pd.Series:
    """A name in Latin letters."""
    return pd.Series([latin_name(t) for t in text])


@F.pandas_udf(T.ArrayType(T.StringType()))
def partner_keys(text: pd.Series) -> pd.Series:
    return pd.Series([keys_of(t, True) for t in text])


def text_pairs(queries: DataFrame, partners: DataFrame, query: str, partner: str, probes: int = 6) -> DataFrame:
    """_q and _d: distinct texts of a query and a partner that share the query's whole consonants or one of its ``probes`` rarest keys.

    An equi-join on keys. How many partners have a key is counted first, so that a query meets partners by what is rare in it; common words alone bring no pair.
    """
    have = partners.groupBy(F.col(partner).alias("_d")).agg(F.count("*").alias("_c")).where("_d IS NOT NULL")
    have = have.select("_d", "_c", F.explode(partner_keys("_d")).alias("_k")).where("_k <> 's'")
    count = have.groupBy("_k").agg(F.sum("_c").alias("_n"))
    ask = queries.select(F.col(query).alias("_q")).where("_q IS NOT NULL").distinct().select("_q", query_keys("_q").alias("_all"))
    ask = ask.select("_q", F.get("_all", F.lit(0)).alias("_whole"), F.explode("_all").alias("_k")).join(count.hint("merge"), "_k")
    ask = ask.withColumn("_r", F.row_number().over(Window.partitionBy("_q").orderBy("_n", "_k"))).where((F.col("_r") <= probes) | (F.col("_k") == F.col("_whole")))
    return by_query(ask.select("_q", "_k").join(have.hint("merge"), "_k").select("_q", "_d"))


def by_query(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (_q, _d), those of a query one after another, so that ratios with the words that its candidates share are found again."""
    spark = pairs.sparkSession  # by number: pairs are few bytes for the time that their measures take, and would be joined to one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return pairs.repartition(tasks, "_q").distinct().sortWithinPartitions("_q", "_d")


def match_names(queries: DataFrame, partners: DataFrame, query_id: str, query: str, partner_id: str, partner: str, model: Model, rules: Rules = Rules(), probes: int = 6) -> DataFrame:
    """``query_id``, ``query``, ``partner_id``, ``partner`` and the columns of ``decide`` for pairs that match or are to be reviewed.

    Ids are taken to be unique and the two id columns to have different names. Null names have no keys and meet nobody. Equal texts are met and judged once; rows get their pairs after that.
    """
    pairs = measured(text_pairs(queries, partners, query, partner, probes)).withColumn("_m", probability(F.col("_f"), model))
    judged = pairs.select("_q", "_d", *[c.alias(name) for name, c in decide(F.col("_f"), F.col("_m"), model, rules).items()]).where("decision <> 'reject'")
    asked, there = queries.select(query_id, query, F.col(query).alias("_q")), partners.select(partner_id, partner, F.col(partner).alias("_d"))
    out = asked.join(judged.hint("merge"), "_q").join(there.hint("merge"), "_d")
    return out.select(query_id, query, partner_id, partner, "score", "model_score", "rule_score", "decision", "reason")


def train(pairs: DataFrame, query: str = "query", candidate: str = "candidate", label: str = "label", strength: float = 1.5) -> Model:
    """A model from labelled pairs: logistic regression with classes of equal weight, penalised by half the squared coefficients over ``strength`` times the rows' weights.

    The fit runs on Spark over all pairs; labels are 0 or 1, both have to occur. Pairs of equal texts and labels are measured once and weigh as many rows as they are.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    sizes = {int(r["l"]): r["n"] for r in pairs.groupBy(F.col(label).cast("int").alias("l")).agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        raise ValueError("both labels, 0 and 1, have to occur")
    total = sum(sizes.values())
    weight = F.when(F.col(label) == 1, total / (2 * sizes[1])).otherwise(total / (2 * sizes[0]))
    texts = pairs.groupBy(F.col(query).alias("_q"), F.col(candidate).alias("_d"), F.col(label).cast("double").alias("label")).agg(F.sum(weight).alias("weight"))
    cores = pairs.sparkSession.sparkContext.defaultParallelism  # by number: texts are few bytes, and would be joined to one task
    rows = texts.repartition(cores, "_q", "_d").select(array_to_vector(features("_q", "_d")).alias("features"), "label", "weight")
    fit = LogisticRegression(maxIter=500, tol=1e-9, regParam=1 / (strength * total), elasticNetParam=0.0, standardization=False, weightCol="weight").fit(rows)
    return Model(float(fit.intercept), dict(zip(FEATURES, map(float, fit.coefficients))))
