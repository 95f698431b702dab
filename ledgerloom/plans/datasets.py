"""Queries of the supervised dataset: documents as examples, their texts and lines as contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset
from . import tables as t
from .queries import query

# Contents: a document's whole text, and the words of its first line if they are many.
_SPLIT = """k AS (SELECT doc_id AS id, 't' || md5(text) AS h FROM documents WHERE text IS NOT NULL UNION SELECT doc_id, 'l' || md5(split_part(text, chr(10), 1)) FROM documents WHERE length(split_part(text, chr(10), 1)) >= 40),
s AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1), e AS (SELECT DISTINCT id, h FROM k JOIN s USING (h)),
r AS (SELECT id, id AS other FROM e UNION SELECT r.id, b.id FROM r JOIN e a ON a.id = r.other JOIN e b ON b.h = a.h),
c AS (SELECT doc_id AS id, coalesce(m, doc_id) AS component FROM documents LEFT JOIN (SELECT id, min(other) AS m FROM r GROUP BY id) q ON q.id = doc_id),
p AS (SELECT id, component, ('0x' || left(md5('3:' || component), 8))::BIGINT % 100 AS nth FROM c),
d AS (SELECT id, component, CASE WHEN nth < 80 THEN 'train' WHEN nth < 90 THEN 'validation' ELSE 'test' END AS split FROM p)"""


def _split(spark, d):
    docs = t.table(spark, d, "documents")
    first = F.substring_index("text", "\n", 1)
    contents = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.array(F.concat(F.lit("t"), F.md5("text")), F.when(F.length(first) >= 40, F.concat(F.lit("l"), F.md5(first))))).alias("h")).where("h IS NOT NULL")
    return dataset.leakfree(docs.select(F.col("doc_id").alias("id")), contents, seed="3"), contents


@query("m10_leakfree_split", f"WITH RECURSIVE {_SPLIT} SELECT id, component, split FROM d")
def m10_split(spark, d):
    """Documents that share a text or a long first line, or are joined by others that do, in one split."""
    return _split(spark, d)[0]


_TARGET = """e AS (SELECT o_orderkey AS id, [o_custkey % 30] AS nations, [o_custkey % 7] AS regions, list_distinct([o_orderkey % 90, o_custkey % 150]) AS suppliers, [o_orderkey % 2500] AS parts, [o_custkey] AS customers, CASE WHEN o_orderkey % 3 = 0 THEN [] ELSE [o_orderkey % 26] END AS taxes, [o_orderkey % 400] AS journals FROM orders),
x AS (SELECT id, 'nations' AS c, unnest(nations) AS i FROM e UNION ALL SELECT id, 'regions', unnest(regions) FROM e UNION ALL SELECT id, 'suppliers', unnest(suppliers) FROM e UNION ALL SELECT id, 'parts', unnest(parts) FROM e
  UNION ALL SELECT id, 'customers', unnest(customers) FROM e UNION ALL SELECT id, 'taxes', unnest(taxes) FROM e UNION ALL SELECT id, 'journals', unnest(journals) FROM e),
n AS (SELECT 'nations' AS c, n_nationkey AS i, n_name AS name FROM nation UNION ALL SELECT 'regions', r_regionkey, r_name FROM region UNION ALL SELECT 'suppliers', s_suppkey, s_name FROM supplier UNION ALL SELECT 'parts', p_partkey, p_name FROM part
  UNION ALL SELECT 'customers', c_custkey, c_name FROM customer WHERE c_custkey % 50 > 0 UNION ALL SELECT 'taxes', n_nationkey, 'tax ' || n_nationkey FROM nation UNION ALL SELECT 'journals', p_partkey, p_brand FROM part),
j AS (SELECT x.id, x.c, x.i, n.i IS NOT NULL AS known, name FROM x LEFT JOIN n ON n.c = x.c AND n.i = x.i)"""


def _targets(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.array().cast("array<bigint>")
    ids = {"nations": F.array(c % 30), "regions": F.array(c % 7), "suppliers": F.array(k % 90, c % 150), "parts": F.array(k % 2500), "customers": F.array(c), "taxes": F.when(k % 3 == 0, none).otherwise(F.array(k % 26)), "journals": F.array(k % 400)}
    table = {
        "nations": t.table(spark, d, "nation").select("n_nationkey", "n_name"), "regions": t.table(spark, d, "region").select("r_regionkey", "r_name"), "suppliers": t.table(spark, d, "supplier").select("s_suppkey", "s_name"),
        "parts": t.table(spark, d, "part").select("p_partkey", "p_name"), "customers": t.table(spark, d, "customer").where("c_custkey % 50 > 0").select("c_custkey", "c_name"),
        "taxes": t.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("tax "), F.col("n_nationkey").cast("string"))), "journals": t.table(spark, d, "part").select("p_partkey", "p_brand"),
    }
    return dataset.with_names(t.table(spark, d, "orders").select(k.alias("id"), *[v.alias(n) for n, v in ids.items()]), table)


_CATALOGS = ("nations", "regions", "suppliers", "parts", "customers", "taxes", "journals")


@query(
    "j24_catalog_names",
    f"""WITH {_TARGET} SELECT id, {", ".join(f"coalesce(string_agg(name, '|' ORDER BY i) FILTER (c = '{c}' AND known), '') AS {c}" for c in _CATALOGS)}, coalesce(string_agg(c || ':' || i, '|' ORDER BY c || ':' || i) FILTER (NOT known), '') AS unresolved FROM j GROUP BY id""",
)
def j24(spark, d):
    """The ids of every order's targets in seven catalogs, in one join."""
    out = _targets(spark, d)
    return out.select("id", *[F.array_join(f"{c}_names", "|").alias(c) for c in _CATALOGS], F.array_join("unresolved", "|").alias("unresolved"))


@query(
    "m10_dataset_gates",
    f"""WITH RECURSIVE {_SPLIT}, u AS (SELECT id, split, CASE WHEN id % 40 = 7 THEN 1 ELSE 0 END AS unresolved FROM d),
    l AS (SELECT count(*) AS n FROM (SELECT h FROM k JOIN d ON d.id = k.id GROUP BY h HAVING count(DISTINCT split) > 1))
    SELECT 'unique_ids' AS gate, (SELECT count(id) - count(DISTINCT id) FROM u) AS value, (SELECT count(id) = count(DISTINCT id) FROM u) AS ok UNION ALL SELECT 'leaked_contents', n, n = 0 FROM l
    UNION ALL SELECT 'unresolved', sum(unresolved)::BIGINT, sum(unresolved) <= 0 FROM u UNION ALL SELECT 'unlabelled', count(*) FILTER (split IS NULL), count(*) FILTER (split IS NULL) = 0 FROM u
    UNION ALL SELECT 'rows_train', count(*) FILTER (split = 'train'), count(*) FILTER (split = 'train') >= 500 FROM u UNION ALL SELECT 'rows_validation', count(*) FILTER (split = 'validation'), count(*) FILTER (split = 'validation') >= 10 FROM u
    UNION ALL SELECT 'rows_test', count(*) FILTER (split = 'test'), count(*) FILTER (split = 'test') >= 100000000 FROM u""",
)
def m10_gates(spark, d):
    """The split of all documents before its gates: some hold, those of unresolved ids and of the test half's size don't."""
    rows, contents = _split(spark, d)
    rows = rows.withColumn("unresolved", F.when(F.col("id") % 40 == 7, F.array(F.lit("x:1"))).otherwise(F.array().cast("array<string>")))
    return dataset.gates(rows, contents, {"train": 500, "validation": 10, "test": 100_000_000})
