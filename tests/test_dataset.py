"""Splits, catalog names and gates against plain loops."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dataset


def test_leakfree(spark):
    contents = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None), (6, "d"), (7, "d"), (7, "d"), (8, "e"), (9, "e"), (3, "e"), (99, "a")]
    ids = spark.createDataFrame([(k,) for k in range(1, 40)], "id long").withColumn("set", F.lit("clash"))
    links = spark.createDataFrame(contents, "id long, h string")
    out = {r.id: r for r in dataset.leakfree(ids, links).collect()}
    assert {k: r.component for k, r in out.items()} == {k: 1 if k in (1, 2, 3, 8, 9) else 6 if k in (6, 7) else k for k in range(1, 40)}
    assert all(out[a].split == out[b].split for a, b in ((1, 9), (6, 7))) and {r.split for r in out.values()} == {"train", "validation", "test"}
    with pytest.raises(ValueError):
        dataset.split_of(F.lit(1), (("train", 50),))
    found = {r.gate: (r.value, r.ok) for r in dataset.gates(dataset.leakfree(ids, links).withColumn("unresolved", F.array().cast("array<string>")), links, {"train": 1, "test": 100}).collect()}
    assert found["leaked_contents"] == (0, True) and found["unique_ids"] == (0, True) and found["rows_train"][1] and not found["rows_test"][1] and found["unlabelled"] == (0, True)
    naive = ids.withColumn("split", F.when(F.col("id") == 1, "test").when(F.col("id") == 5, None).otherwise("train")).withColumn("unresolved", F.array(F.lit("x")))
    found = {r.gate: (r.value, r.ok) for r in dataset.gates(naive.unionByName(naive.where("id = 2")), links, {"train": 1}).collect()}
    assert found["leaked_contents"] == (1, False) and found["unique_ids"] == (1, False) and found["unresolved"] == (40, False) and found["unlabelled"] == (1, False)


def test_names(spark):
    rows = spark.createDataFrame([(1, [2, 1, 2], [5]), (2, [], None), (3, [9, None], [5, 6])], "id long, a array<long>, b array<long>")
    one, two = spark.createDataFrame([(1, "x"), (2, "y"), (2, "w")], "i long, n string"), spark.createDataFrame([(5, None)], "i long, n string")
    got = {r.id: (r.a_names, r.b_names, r.unresolved) for r in dataset.with_names(rows, {"a": one, "b": two}).collect()}
    assert got == {1: (["x", "w"], [None], []), 2: ([], [], []), 3: ([], [None], ["a:9", "b:6"])}
