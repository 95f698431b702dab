"""Queries about names: matching, training and text search, over people derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import name_match as nm
from ..operators import text_index
from . import tables as t
from .queries import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]

#: Given names in two Latin spellings and in Arabic.
NAMES = (
    ("Karim", "Kareem", "كريم"), ("Laila", "Layla", "ليلى"), ("Samira", "Sameera", "سميرة"), ("Tamer", "Tamir", "تامر"), ("Yasmin", "Yasmeen", "ياسمين"), ("Bilal", "Belal", "بلال"),
    ("Dalia", "Dalya", "داليا"), ("Farid", "Fareed", "فريد"), ("Habib", "Habeeb", "حبيب"), ("Idris", "Edris", "إدريس"), ("Jawad", "Jawwad", "جواد"), ("Kamal", "Kamaal", "كمال"),
    ("Lubna", "Loubna", "لبنى"), ("Majid", "Majed", "ماجد"), ("Nabil", "Nabeel", "نبيل"), ("Qasim", "Qasem", "قاسم"), ("Rashid", "Rasheed", "رشيد"), ("Salma", "Selma", "سلمى"),
    ("Zainab", "Zaynab", "زينب"), ("Wisam", "Wesam", "وسام"), ("Hind", "Hend", "هند"), ("Fawzi", "Fouzi", "فوزي"), ("Munir", "Mouneer", "منير"), ("Ghazi", "Ghazy", "غازي"),
)


def person(key: int, spelling: int) -> str:
    """The name of a key below 13,824: three given names, each as spelt."""
    n = len(NAMES)
    return " ".join(NAMES[k % n][spelling] for k in (key, key // n + key, key // n**2 + 7 * key))


def person_column(key: Column, spelling: Column) -> Column:
    """``person`` as a column."""
    n = len(NAMES)
    table = F.array(*[F.array(*[F.lit(x) for x in group]) for group in NAMES])
    parts = [key, F.floor(key / n) + key, F.floor(key / n**2) + 7 * key]
    return F.concat_ws(" ", *[F.get(F.get(table, (k % n).cast("int")), spelling.cast("int")) for k in parts])


#: Fitted by ``name_match.train`` on 15,800 pairs of such people (whole names, parts, with words around, and others' names).
MODEL = nm.Model(
    -10.5509,
    {
        "native_full_ratio": -1.698, "latin_full_ratio": -1.1954, "strict_full_ratio": 1.5935, "relaxed_full_ratio": 1.1413,
        "native_length_ratio": -2.3042, "latin_length_ratio": -2.7007, "strict_length_ratio": -6.3244, "relaxed_length_ratio": -3.7409,
        "native_exact": 0.0, "latin_exact": 0.0272, "strict_exact": 1.3013, "relaxed_exact": 0.2627,
        "native_best_span_ratio": -0.5764, "latin_best_span_ratio": 3.1626, "strict_best_span_ratio": 6.3774, "relaxed_best_span_ratio": 5.6562,
        "native_exact_span": 0.0, "latin_exact_span": 0.0283, "strict_exact_span": 3.046, "relaxed_exact_span": 0.8657,
        "native_best_span_length_ratio": 1.1635, "latin_best_span_length_ratio": 1.5564, "strict_best_span_length_ratio": 0.9952, "relaxed_best_span_length_ratio": 1.963,
        "native_bigram_jaccard": 0.1024, "latin_bigram_jaccard": -2.4375, "strict_bigram_jaccard": 3.0732, "relaxed_bigram_jaccard": 2.8118,
        "native_trigram_jaccard": 0.0747, "latin_trigram_jaccard": -0.5209, "latin_prefix_ratio": 0.2032, "strict_prefix_ratio": 3.3442,
        "query_in_candidate": 0.0, "candidate_in_query": 0.0, "first_strict_char_match": -0.788, "query_token_count": -1.4563, "candidate_token_count": 1.547,
        "candidate_is_numeric": 0.0, "query_has_arabic": 1.0284, "candidate_has_arabic": 1.1063, "both_have_arabic": 0.0,
    },
)


def customers(spark, d):
    """c_custkey and a name in the spelling of its key, in which others have a trade."""
    k = F.col("c_custkey")
    name = person_column(k * 37 % 13824, k % 3)
    return t.table(spark, d, "customer").select(k, F.when(k % 5 == 2, F.concat(name, F.lit(" Trading"))).otherwise(name).alias("name"))


def suppliers(spark, d):
    """s_suppkey and the name of a customer (in another spelling) under ``partner``."""
    k = F.col("s_suppkey")
    return t.table(spark, d, "supplier").select(k, person_column(k * 5 * 37 % 13824, (k + 1) % 3).alias("partner"))


@query("j19_name_match")
def j19(spark, d):
    """Every hundredth customer's name against all suppliers' names, in three spellings of two scripts."""
    asked = customers(spark, d).where("c_custkey % 100 = 0")
    found = nm.match_names(asked, suppliers(spark, d), "c_custkey", "name", "s_suppkey", "partner", MODEL)
    return found.select("c_custkey", "s_suppkey", "name", "partner", F.round("score", 6).alias("score"), F.round("rule_score", 2).alias("rule_score"), "decision", "reason")


@query("m07_name_training")
def m07(spark, d):
    """A model from four fifths of the suppliers, each with its own and with another customer's name, and what it says of the last fifth."""
    same = F.col("s_suppkey") * 5
    other = (same + 1 + F.col("s_suppkey") % 7) % 13824
    k = suppliers(spark, d).select("s_suppkey", "partner", F.explode(F.array(F.struct(F.lit(1).alias("label"), same.alias("k")), F.struct(F.lit(0).alias("label"), other.alias("k")))).alias("x"))
    pairs = k.select("s_suppkey", "partner", "x.label", person_column(F.col("x.k") * 37 % 13824, F.col("s_suppkey") % 3).alias("name"))
    model = nm.train(pairs.where("s_suppkey % 5 <> 0"), "name", "partner")
    return nm.score_pairs(pairs.where("s_suppkey % 5 = 0"), "name", "partner", model).select("s_suppkey", "label", F.round("model_score", 3).alias("model_score"), "decision")


_RECORDS = """r AS (SELECT c_custkey AS id, c_name AS a, c_mktsegment AS b FROM customer UNION ALL SELECT p_partkey + 1000000000000, p_name, p_brand || ' ' || p_type FROM part),
x AS (SELECT id, unnest([{'field': 0, 'text': lower(a)}, {'field': 1, 'text': lower(b)}], recursive := true) FROM r)"""


def records(spark, d):
    """id and two texts of every customer and every part."""
    customer = t.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("a"), F.col("c_mktsegment").alias("b"))
    part = t.table(spark, d, "part").select((F.col("p_partkey") + F.lit(1_000_000_000_000)).alias("id"), F.col("p_name").alias("a"), F.concat_ws(" ", "p_brand", "p_type").alias("b"))
    return customer.unionByName(part)


@query(
    "j20_text_search",
    f"""WITH {_RECORDS},
    q AS (SELECT p_partkey AS query_id, unnest([lower(p_name), lower(right(p_type, 5)), lower(p_brand) || ' ', left(lower(p_name), 2) || 'z', '#' || lpad((p_partkey // 100)::VARCHAR, 7, '0')]) AS term FROM part WHERE p_partkey % 100 = 0
      UNION ALL SELECT c_custkey + 1000000000000, unnest([right(c_name, 4), left(lower(c_mktsegment), 2), '']) FROM customer WHERE c_custkey % 100 = 0),
    h AS (SELECT query_id, id, field, term, -length(term)::DOUBLE / length(text) AS covers FROM (SELECT DISTINCT * FROM q WHERE term <> '') JOIN x ON contains(text, term)),
    f AS (SELECT query_id, id, field, min((covers, term)) AS best FROM h GROUP BY query_id, id, field QUALIFY row_number() OVER (PARTITION BY query_id, field ORDER BY id DESC) <= 1200),
    o AS (SELECT query_id, id, min(field) AS first, min((best[1], field, best[2])) AS best FROM f GROUP BY query_id, id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY min(field), id DESC) <= 5000)
    SELECT query_id, id, best[2] AS field, best[3] AS term FROM o""",
)
def j20(spark, d):
    """Terms of every hundredth part and customer (words, ends of codes, two letters), against the texts of all."""
    p = t.table(spark, d, "part").where("p_partkey % 100 = 0")
    number = F.concat(F.lit("#"), F.lpad(F.floor(F.col("p_partkey") / 100).cast("string"), 7, "0"))
    of_part = F.explode(F.array(F.col("p_name"), F.expr("right(p_type, 5)"), F.concat("p_brand", F.lit(" ")), F.concat(F.substring("p_name", 1, 2), F.lit("z")), number))
    c = t.table(spark, d, "customer").where("c_custkey % 100 = 0")
    of_customer = F.explode(F.array(F.expr("right(c_name, 4)"), F.substring("c_mktsegment", 1, 2), F.lit("")))
    terms = p.select(F.col("p_partkey").alias("query_id"), of_part.alias("term")).unionByName(c.select((F.col("c_custkey") + F.lit(1_000_000_000_000)).alias("query_id"), of_customer.alias("term")))
    return text_index.search(text_index.TextIndex.of(records(spark, d), "id", ["a", "b"]), terms)


def order_lines(spark, d):
    """id, date, partner_id, name and ref of every order; half of the names tell the customer in another spelling."""
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_custkey").alias("partner_id"), "o_orderpriority")
    told = F.concat(F.lit("Paid by "), person_column(F.col("partner_id") * 37 % 13824, (F.col("id") + 1) % 3), F.lit(", order"))
    return o.select("id", "date", "partner_id", F.when(F.col("id") % 2 == 0, told).otherwise(F.col("o_orderpriority")).alias("name"), F.concat(F.lit("SO/"), F.col("id").cast("string")).alias("ref"))


@query("j20_global_search")
def j20_global(spark, d):
    """Every hundredth customer by name: the orders that have to do with them, by customer or by text."""
    k = F.col("c_custkey")
    asked = t.table(spark, d, "customer").where("c_custkey % 100 = 0").select(k.alias("query_id"), person_column(k * 37 % 13824, (k + 1) % 3).alias("name"))
    partners = customers(spark, d).select(k.alias("partner_id"), F.col("name").alias("partner")).cache()
    lines = order_lines(spark, d).cache()  # read six times
    found = text_index.global_search(asked.cache(), partners, lines, ["name", "ref"], MODEL)
    return found.select("query_id", "id", "field", "text", F.round("score", 6).alias("score"), "reason")
