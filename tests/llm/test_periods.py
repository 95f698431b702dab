"""Runs of repeated words against a search over all starts and periods."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import periods
from ledgerloom.llm.queries import op11_periodic_runs

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            part = w[i : j + q]
            if length >= max(least, times * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = set()
    for s, length, q in found:
        gone |= set(range(s + q, s + length))
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def damaged(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=6), st.sampled_from([(6, 4), (1, 3), (9, 5)]))
def test_all_periods(docs, rule):
    docs = sorted(docs, key=len, reverse=True)
    sizes = np.array([len(d) for d in docs])
    names = np.array([x for d in docs for x in d], np.int64)
    start, end, q = periods.runs_of(names, sizes, periods.Periods(*rule))
    firsts = np.cumsum(sizes) - sizes
    want = [(int(f) + s, int(f) + s + n, p) for f, d in zip(firsts, docs) for s, n, p in brute(d, *rule)]
    assert sorted(zip(start.tolist(), end.tolist(), q.tolist())) == sorted(want)


def texts():
    out = {r[0]: r[1] for r in cases.rows()}
    blocks = ["a b c " * 9, "x " * 40, "p q " * 3 + "p", "one two three four five " * 12 + "tail", "é 中 \U0001f600\n" * 5, "u v u v u v u v w u v u v u v u v"]
    for k in range(300):
        out[100 + k] = f"{cases.passage(k, 7)} {blocks[k % 6]} {cases.passage(k + 1, 5 + k % 40)} {blocks[(k * 5 + 1) % 6]}"
    return out


def test_operator(spark):
    docs = cases.documents(spark)
    out = {r.doc_id: r for r in periods.find_runs(docs.repartition(3)).collect()}
    want = {r[0]: WORD.findall(r[1] or "") for r in cases.rows()}
    assert out.keys() == want.keys()
    for i, w in want.items():
        found = brute(w) if len(w) < 3000 else [(0, len(w), 1)]  # document 11 is one word 6000 times
        assert out[i].n_words == len(w)
        assert [tuple(r) for r in out[i].runs] == found
        assert out[i].collapsed == collapsed(w, found)
    assert periods.find_runs(cases.empty(spark)).collect() == []


def test_rows_that_repeat(spark):
    """Rows of one id, and without one, are judged on their own."""
    rows = [(1, "a " * 8), (1, "a " * 8), (None, "b c " * 5), (None, None), (2, "b c " * 5)]
    got = periods.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == [
        (0, 0, [], ""), (0, 10, [(0, 10, 2)], "b c"), (1, 8, [(0, 8, 1)], "a"), (1, 8, [(0, 8, 1)], "a"), (2, 10, [(0, 10, 2)], "b c"),
    ]


def test_rules():
    with pytest.raises(ValueError):
        periods.Periods(times=2)


def test_query(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(list(rows.items()) + [(None, "z " * 9)], "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 1
    changed = 0
    for i, text in (rows | {None: "z " * 9}).items():
        w = WORD.findall(text or "")
        after = damaged(i, w)
        changed += after != w
        found = brute(after) if i != 11 else [(0, 6000, 1)]
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(after, found)))
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
    assert changed > 15
