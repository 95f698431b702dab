"""Conversation repair against a search over all edits, and against its SQL."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

from pyspark.sql import functions as F

from ledgerloom.llm import turns
from ledgerloom.llm.queries import op12_turn_repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
INITIALS = re.compile(r"(s?(ua)+)?\Z")
INF = 10**9


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        words = text.strip(" \t\n\x0b\f\r")
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def search(rows, kinds):
    """Cheapest edits by trying all from every place, with the output's initials as they grow (least audits by comparing whole ones)."""

    def follows(so_far, initial):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[so_far].count(initial) == 1

    @lru_cache(maxsize=None)
    def best(i, last, inserts):
        found = []
        if i == len(rows):
            if last in ("", "a"):
                found.append((0, "", ()))
        else:
            role, text = rows[i]
            more = 3 if kinds[i] == "truncated" else 0
            found.append(add(4, "D", (), best(i + 1, last, 0)))
            if kinds[i] in ("", "truncated"):
                if role[:1] in ("s", "u", "a") and follows(last, role[:1]):
                    found.append(add(more, "K", ((role, text),), best(i + 1, role[0], 0)))
                for new in ("user", "assistant"):
                    if follows(last, new[0]):
                        found.append(add(3 + more, "R", ((new, text),), best(i + 1, new[0], 0)))
        if inserts < 3:
            for new in ("user", "assistant"):
                if follows(last, new[0]):
                    found.append(add(3, "I", ((new, ""),), best(i, new[0], inserts + 1)))
        return min(found, default=(INF, "", ()))

    def add(cost, letter, line, rest):
        return (rest[0] + cost, letter + rest[1], line + rest[2])

    return best(0, "", 0)


def expected(rows):
    kept = {}
    for c, t, role, text in damaged(rows):
        kept.setdefault(c, []).append((t is not None, t or 0, role, text))
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted(kept.get(c, []))
        lines = [(r[2], r[3]) for r in mine]
        kinds = faults(lines)
        numbers = {r[1] for r in mine if r[0]}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        initials = [x[0][:1] for x in lines]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, text = search(tuple(lines), tuple(kinds))
        assert INITIALS.match("".join(x[0][0] for x in text))
        body = "\n".join(f"{a}:{b}" for a, b in text)
        out[c] = (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def conversations():
    rng, rows = random.Random(5), []
    for c in range(250):
        n = rng.choice([1, 2, 3, 4, 5, 6, 9, 14])
        for t in range(n):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            text = rng.choice(["Yes.", "No!", "And then", "Why?  \n", " \t", None, "", f"t{rng.random()}.", f"t{rng.random()}"])
            rows.append((c if c else None, None if rng.random() < 0.03 else t * rng.choice([1, 1, 1, 3]), role, text))
    rows += [(900, t, "user", "Same.") for t in range(40)] + [(901, 1, "user", "Tie."), (901, 1, "user", "Tie."), (901, 1, "assistant", "Tie.")]
    rows += [(902, -(1 << 63), "user", "Far."), (902, (1 << 63) - 1, "assistant", "Far."), (902, 0, "assistant", "y" * 100_000)]
    return rows


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_query(spark, tmp_path):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("_c", "_t", "fault", "copy", "_n")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in op12_turn_repair(spark, str(tmp_path)).collect()}
    want = expected(rows)
    want[902] = (min(want[902][0], (1 << 63) - 1), *want[902][1:])
    assert got == want
    assert len({audit for *_, audit, _ in got.values()}) > 60


def test_operator(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "assistant", "A."), (2, 0, "assistant", "A"), (3, 0, "user", None)]
    got = {r.conv_id: r for r in turns.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert (got[1].audit, got[1].cost, [tuple(x) for x in got[1].repaired]) == ("KKK", 0, [("system", "S."), ("user", "Q?"), ("assistant", "A.")])
    assert (got[2].audit, got[2].cost, got[2].repaired) == ("D", 4, [])  # keeping it would cost an insert and 3 for its end
    assert (got[3].audit, got[3].blank, got[3].gaps) == ("D", 1, 0)
    cheap = turns.Costs(rerole=1, delete=9, insert=1, truncated=1)
    got = {r.conv_id: r for r in turns.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), cheap).collect()}
    assert (got[2].audit, got[2].cost, [tuple(x) for x in got[2].repaired]) == ("IK", 2, [("user", ""), ("assistant", "A")])
    assert turns.repair(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).collect() == []
