"""Search by trigrams against contains() over all texts."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import name_match as nm
from ledgerloom.operators import text_index as ti
from ledgerloom.plans.people import MODEL, person


def rows():
    rng = random.Random(2)
    out = [(k, "".join(rng.choices("abcd ", k=rng.choice([1, 2, 3, 8, 30]))), rng.choice([None, "", "Ab", "xyz é中", "aaaa"])) for k in range(400)]
    return out + [(400, None, None), (401, "a" * 20_000 + "needle" + "b" * 20_000, "%_\\"), (402, "NEEDLE", "ne")]


TERMS = ["a", "b ", "ab", "abc", "abcd", "aaaa", "AbC", "zzz", "needle", "中", "é中", "yz é", "_", "%_", "", None, "d a", "edl"]


def test_find(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, "id long, a string, b string").withColumn("term", F.lit("clash")).repartition(3)
    terms = spark.createDataFrame([(t,) for t in TERMS + ["abc"]], "term string")
    want = {(t.lower(), i, k) for t in TERMS if t for i, *texts in data for k, x in enumerate(texts) if x and t.lower() in x.lower()}
    index = ti.TextIndex.of(df, "id", ["a", "b"])
    for most in (1, 3):
        assert [tuple(r) for r in index.find(terms, most).collect()].sort() is None and {tuple(r) for r in index.find(terms, most).collect()} == want
    stored = index.write(str(tmp_path / "index"), files=3)
    found = [tuple(r) for r in stored.find(terms).collect()]
    assert len(found) == len(want) and set(found) == want
    assert ti.TextIndex.of(df.limit(0), "id", ["a", "b"]).find(terms).collect() == []


def test_search_limits(spark):
    data = [(k, 100 - k, "apple pie" if k % 2 else "apple", "green apple" if k < 60 else "pear") for k in range(100)]
    df = spark.createDataFrame(data, "id long, date long, a string, b string")
    terms = spark.createDataFrame([(1, "apple"), (1, "APPLE pie"), (2, "pear"), (3, None)], "query_id long, term string")
    got = ti.search(ti.TextIndex.of(df, "id", ["a", "b"]), terms, df.select("id", "date"), ti.Limits(field=20, total=30)).collect()
    mine = {r.id: (r.field, r.term) for r in got if r.query_id == 1}
    assert set(mine) == set(range(20)) and all(v == ((0, "apple pie") if k % 2 else (0, "apple")) for k, v in mine.items())
    assert {r.id for r in got if r.query_id == 2} == set(range(60, 80)) and not [r for r in got if r.query_id == 3]
    few = ti.search(ti.TextIndex.of(df, "id", ["a", "b"]), terms.where("query_id < 3"), df.select("id", "date"), ti.Limits(field=20, total=7, terms=1)).collect()
    assert sorted(r.id for r in few if r.query_id == 1) == list(range(7)) and {r.term for r in few if r.query_id == 1} == {"apple"}


def test_global_search(spark):
    people = [(k, person(k * 37, k % 3)) for k in range(40)]
    lines = [(k, f"2024-01-{1 + k % 28:02d}", k % 40 if k % 3 else None, f"Paid by {person((k % 40) * 37, (k + 1) % 3)}" if k % 2 else "fee", None if k % 5 else f"SO/{k}") for k in range(200)]
    queries = spark.createDataFrame([(1, person(3 * 37, 1)), (2, person(8 * 37, 2)), (3, None)], "query_id long, name string")
    partners = spark.createDataFrame(people, "partner_id long, partner string")
    df = spark.createDataFrame(lines, "id long, date string, partner_id long, name string, ref string")
    got = {(r.query_id, r.id): (r.field, r.text) for r in ti.global_search(queries, partners, df, ["name", "ref"], MODEL).collect()}
    texts = {r[0]: r[3] for r in lines}
    # What the name matches in any text is found, and nothing else.
    every = nm.score_pairs(queries.select("query_id", F.col("name").alias("q")).crossJoin(df.select("id", "name")), "q", "name", MODEL)
    want = {(r.query_id, r.id): ("name", texts[r.id]) for r in every.where("decision = 'match' AND name <> ''").collect()}
    assert got.items() <= want.items() and len(got) >= 0.95 * len(want)
    assert {i for q, i in got if q == 1} >= {k for k in range(200) if k % 2 and k % 40 == 3}
