"""Names: measures against plain definitions, pairs against all pairs, and a model's scores against SQL."""

import itertools
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import names
from ledgerloom.operators import name_match as nm
from ledgerloom.plans.people import MODEL, NAMES, person


def plain(values):
    return dict(zip(nm.FEATURES, values))


def test_measures():
    got = plain(nm.pair_features("غلام", "Mr Ghulam Ali"))
    assert len(got) == 41 and all(0 <= v <= 1 for v in got.values())
    assert got["latin_full_ratio"] == SequenceMatcher(None, "ghlam", "mr ghulam ali").ratio()
    assert got["latin_best_span_ratio"] == max(SequenceMatcher(None, "ghlam", s).ratio() for s in ("mr", "ghulam", "ali", "mr ghulam", "ghulam ali", "mr ghulam ali"))
    assert (got["strict_exact_span"], got["relaxed_exact_span"], got["native_exact_span"]) == (1, 1, 0)
    assert (got["query_has_arabic"], got["candidate_has_arabic"], got["both_have_arabic"]) == (1, 0, 0)
    assert (got["query_token_count"], got["candidate_token_count"]) == (0.1, 0.15)
    same = plain(nm.pair_features("Ahmed Salem", "ahmed  SALEM"))
    assert all(same[f"{f}_{m}"] == 1 for f in nm.FORMS for m in ("full_ratio", "exact", "exact_span", "bigram_jaccard", "best_span_length_ratio"))
    assert plain(nm.pair_features("hmd", "hamad x"))["strict_exact_span"] == 1
    part = plain(nm.pair_features("salem", "abusalem trading"))
    assert (part["query_in_candidate"], part["candidate_in_query"]) == (1, 0)
    assert plain(nm.pair_features("12", "1 2"))["candidate_is_numeric"] == 1
    assert set(nm.pair_features(None, None)) == {0.0} and set(nm.pair_features("", "!!")) == {0.0}
    assert nm.pair_features("أحمد", "احمد")[nm.FEATURES.index("native_exact")] == 1
    assert nm.jaccard("ab", "abc", 3) == 0 and nm.jaccard("abcd", "abcx", 2) == 2 / 4


def test_best_span_skips_nothing():
    words = ["salem", "slaem", "selam", "samel", "alems", "xx", "salems"]
    for q in words:
        want = max(((SequenceMatcher(None, q, s).ratio(), nm.length_ratio(q, s)) for s in words), default=(0, 0))
        assert nm.best_span(q, words) == want


def test_python_and_column_forms_agree(spark):
    texts = [a for group in NAMES for a in group] + ["Yousef Younis", "aaya", "غاده مؤمن", "phthsh ghwy"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names.latin(F.col("t"), hamza="a").alias("l"), names.skeleton(F.col("t")).alias("s"), names.skeleton(F.col("t"), True).alias("r")).collect()
    for r in rows:
        native, latin, strict, relaxed = nm.written(nm.fold(r.t))
        assert (r.l, r.s, r.r) == (latin, strict, relaxed)


def test_pairs_against_all(spark):
    """All pairs that match by rule are found, and nearly all that the model alone accepts."""
    people = [(k, person(k * 37, k % 3)) for k in range(60)] + [(100, None), (101, ""), (102, "x"), (103, "شركة " + person(37, 2) + " للتجارة")]
    asked = [(k, person(k * 37, (k + 1) % 3)) for k in range(0, 60, 2)] + [(900, None), (901, " "), (902, person(37, 0))]
    left, right = spark.createDataFrame(asked, "q long, name string"), spark.createDataFrame(people, "p long, partner string")
    got = {(r.q, r.p): (round(r.score, 9), r.decision, r.reason) for r in nm.match_names(left, right, "q", "name", "p", "partner", MODEL).collect()}
    every = left.crossJoin(right)
    want = {(r.q, r.p): (round(r.score, 9), r.decision, r.reason) for r in nm.score_pairs(every, "name", "partner", MODEL).where("decision <> 'reject'").collect()}
    assert got.items() <= want.items()
    missed = {k: v for k, v in want.items() if k not in got}
    assert not [k for k, v in missed.items() if v[2] == "exact_span"]
    matches = [k for k, v in want.items() if v[1] == "match"]
    assert len([k for k in matches if k in got]) >= 0.95 * len(matches)
    own = [k for k in range(0, 60, 2) if (k, k) in got]
    assert len(own) >= 28, [(a, b) for a, b in zip(asked, people[::2]) if (a[0], a[0]) not in want]
    assert (902, 103) in got, (902, 103) in want


def test_rejects(spark):
    pairs = spark.createDataFrame([("", "a"), (None, "b"), ("ali", "ali"), ("ali", "zzzz"), ("ali", "ali")], "q string, c string").withColumn("score_", F.lit(1))
    got = [(r.q, r.c, r.decision, r.reason) for r in nm.score_pairs(pairs, "q", "c", MODEL).collect()]
    assert sorted(got, key=str) == sorted([("", "a", "reject", "empty_text"), (None, "b", "reject", "empty_text"), *[("ali", "ali", "match", "exact_span")] * 2, ("ali", "zzzz", "reject", "logistic_regression")], key=str)


def test_training(spark):
    rows = [(person(k, a), person(k if same else k * 7 + 5, b), int(same)) for k in range(0, 600, 11) for a, b in itertools.combinations(range(3), 2) for same in (True, False)]
    pairs = spark.createDataFrame(rows, "query string, candidate string, label int").repartition(3).cache()
    first, second = nm.train(pairs), nm.train(pairs)
    assert first.intercept == pytest.approx(second.intercept, abs=1e-6)
    # Scores from the fitted coefficients, in another engine.
    found = pairs.select(nm.features("query", "candidate").alias("f"), "label").limit(50).select("f", "label", nm.probability(F.col("f"), first).alias("p")).collect()
    linear = " + ".join(f"f[{k + 1}] * {first.coefficients[n]!r}" for k, n in enumerate(nm.FEATURES))
    for r in found:
        assert duckdb.execute(f"SELECT 1 / (1 + exp(-({first.intercept!r} + {linear}))) FROM (SELECT ?::DOUBLE[] AS f)", [r.f]).fetchone()[0] == pytest.approx(r.p, rel=1e-9)
    held = [(person(k, 0), person(k if same else k * 5 + 3, 2), same) for k in range(5, 600, 13) for same in (True, False)]
    judged = nm.score_pairs(spark.createDataFrame(held, "q string, c string, same boolean"), "q", "c", first).select("same", "decision").collect()
    assert sum((r.decision == "match") == r.same for r in judged) >= 0.95 * len(judged)
    with pytest.raises(ValueError):
        nm.train(pairs.where("label = 1"))
