"""Each operator against a brute-force version on documents that hold the odd cases."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, ctw, lines, mixing, near, quality, substrings, suffixes, topk, unigram
from ledgerloom.llm.queries import BPE_FILE, UNIGRAM_FILE, op8_line_dedup

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
TEXTS = {r[0]: r[1] for r in cases.rows()}


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def by_id(df, key="doc_id"):
    got = {r[key]: r for r in df.collect()}
    return got


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).repartition(3)


def cover(n, ranges):
    out = np.zeros(n, bool)
    for a, b in ranges:
        out[a:b] = True
    return out


@pytest.mark.parametrize("window,gram", [(35, 10), (5, 2)])
def test_op1(spark, docs, window, gram):
    words = {i: WORD.findall(t or "") for i, t in TEXTS.items()}
    seen = Counter(tuple(w[k : k + window]) for w in words.values() for k in range(len(w) - window + 1))
    got = by_id(substrings.remove_repeats(docs, window, gram=gram, texts_out=True))
    assert len(got) == len(TEXTS)
    for i, w in words.items():
        bad = cover(len(w), [(k, k + window) for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1])
        kept = " ".join(x for x, b in zip(w, bad) if not b)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256, got[i].kept) == (len(w), bad.sum(), sha(kept.encode()), kept)


def test_op1_index_runs(spark):
    index = substrings.FingerprintIndex(spark, buckets=3, most_runs=2)
    batches = [[(1, 5), (2, 5), (2, 4), (3, 9)], [(3, 8), (4, 1)], [(5, 1), (1, 5)], [(6, 2), (6, 2), (7, 0)]]
    seen: list = []
    for b in batches:
        hits = {r.h: (r.c, r.low, r.high) for r in index.add(spark.createDataFrame(b, "h long, x long")).collect()}
        seen += b
        of = {h: [x for g, x in seen if g == h] for h, _ in b}
        assert hits == {h: (len(x), min(x), max(x)) for h, x in of.items() if len(x) > 1}
        assert len(index.runs) <= 2
    index.compact()
    assert {r.h: r.c for r in spark.table(index.runs[0]).collect()} == dict(Counter(h for h, _ in seen))
    index.drop()
    assert index.runs == []


def test_op1_incremental(spark):
    """Batches through one index: each loses what it has in common with itself and with all before."""
    index, done = substrings.FingerprintIndex(spark, buckets=3, most_runs=2), None
    shared = cases.passage(1, 60)
    steps = [
        {1: "first " + shared + " end", 2: cases.passage(2, 90)},
        {3: cases.passage(9, 20) + " " + shared[:250] + " other", 4: cases.passage(2, 90), 5: cases.passage(7, 50)},
        {6: "x " + cases.passage(7, 50) + " y", 7: shared, 8: cases.passage(13, 45) + " - " + cases.passage(13, 45), 9: None},
    ]
    seen: Counter = Counter()
    for step in steps:
        docs = spark.createDataFrame(list(step.items()), "doc_id long, text string")
        got = by_id(substrings.remove_repeats(docs, index=index, history=done, texts_out=True, batches=2))
        done = docs if done is None else done.unionByName(docs)
        words = {i: WORD.findall(t or "") for i, t in step.items()}
        seen += Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
        for i, w in words.items():
            bad = cover(len(w), [(k, k + 35) for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1])
            assert got[i].kept == " ".join(x for x, b in zip(w, bad) if not b), i
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, index=index)
    index.drop()


def thue_morse(n: int) -> tuple[str, str]:
    """Two words that polynomials modulo a power of two don't tell apart."""
    a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_alike_words_apart(spark):
    a, b = thue_morse(1024)
    rest = cases.passage(3, 34)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {rest}"), (4, f"{b} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near.near_components(docs.where("doc_id < 3")).collect()} == {1: 1, 2: 2}
    assert {r.n_removed for r in substrings.remove_repeats(docs).collect()} == {0}
    assert {r.n_known for r in ctw.score(docs.where("doc_id < 3")).collect()} == {1 + (zlib.crc32(b"%d" % i) % 7 != 2) for i in (1, 2)}


@pytest.mark.parametrize("how", [{}, {"AT_ONCE": 300}, {"AT_ONCE": 300, "GROUP": 200, "BLOCK": 500}, {"GROUP": 0}])
@pytest.mark.parametrize("window,gram", [(100, 20), (12, 4)])
def test_op2(spark, docs, monkeypatch, window, gram, how):
    for name, value in how.items():
        monkeypatch.setattr(suffixes, name, value)
    got = by_id(suffixes.remove_repeats(docs, window, gram=gram, texts_out=True))
    seen: set = set()
    assert len(got) == len(TEXTS)
    for i in sorted(TEXTS):
        data = (TEXTS[i] or "").encode()
        ranges = []
        for k in range(len(data) - window + 1):
            if (s := data[k : k + window]) in seen:
                ranges.append((k, k + window))
            seen.add(s)
        bad = cover(len(data), ranges)
        spans = int((bad[1:] & ~bad[:-1]).sum()) + int(bad[:1].sum())
        kept = np.frombuffer(data, np.uint8)[~bad].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, bytes(got[i].kept)) == (len(data), bad.sum(), spans, sha(kept), kept)


def test_op2_copies_reach_a_block_once(spark, monkeypatch):
    solve = suffixes.repeats_in_block

    def distinct_only(segments, *rest):
        assert len(set(segments)) == len(segments), "copies in a block"
        return solve(segments, *rest)

    monkeypatch.setattr(suffixes, "repeats_in_block", distinct_only)
    text = cases.passage(1, 60)
    start = text.index(" ", 50)
    docs = spark.createDataFrame([(k, text) for k in range(40)] + [(40, "another beginning" + text[start:] + " and end")], "doc_id long, text string")
    got = by_id(suffixes.remove_repeats(docs.repartition(3)))
    assert [got[k].n_removed for k in range(41)] == [0] + [len(text)] * 39 + [len(text) - start]


def test_op2_blocks_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(40):
        window = int(rng.choice([3, 5, 9]))
        segments = [bytes(rng.choice(list(b"ab"), int(rng.integers(window, window + 8)))) for _ in range(int(rng.integers(1, 14)))]
        n = np.array([len(s) - window + 1 for s in segments])
        doc, at = rng.integers(0, 4, len(segments)), np.cumsum(n) * 3
        places = [(segments[i][o : o + window], (doc[i], at[i] + o), (i, o)) for i in range(len(segments)) for o in range(n[i])]
        first: dict = {}
        for s, where, _ in places:
            first[s] = min(first.get(s, where), where)
        who, off = suffixes.repeats_in_block(segments, doc, at, n, window)
        assert set(zip(who.tolist(), off.tolist())) == {key for s, where, key in places if first[s] != where}


def test_op3(spark, docs):
    got = by_id(ctw.score(docs))
    tokens = {i: [*WORD.findall((t or "").translate(LOWER)), None] for i, t in TEXTS.items()}
    train = {i for i in TEXTS if zlib.crc32(str(i).encode()) % 7 != 2}
    count = Counter(w for i in train for w in tokens[i])
    total, distinct = sum(count.values()), len(count)
    depth, nodes = ctw.DEPTH, {}

    def bits(t):
        data = bytes([255] * depth) + t.translate(LOWER).encode() + b"\xff"
        for i in range(depth, len(data)):
            for j in range(8):
                yield data[i - depth : i][::-1], (1 << j) | (data[i] >> (8 - j)), (data[i] >> (7 - j)) & 1

    for i in train:
        for context, place, bit in bits(TEXTS[i] or ""):
            for d in range(depth + 1):
                nodes.setdefault((context[:d], place), [0, 0])[bit] += 1
    children: dict = {}
    for context, place in nodes:
        if context:
            children.setdefault((context[:-1], place), []).append((context, place))

    def kt(k):
        a, b = nodes[k]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted: dict = {}
    for k in sorted(nodes, key=lambda k: -len(k[0])):
        weighted[k] = kt(k) if len(k[0]) == depth else np.logaddexp(kt(k), sum(weighted[c] for c in children[k])) + math.log(0.5)

    def predict(context, place):
        mass, left = 0.0, 1.0
        for d in range(depth + 1):
            k = (context[:d], place)
            a, b = nodes.get(k, (0, 0))
            p = (b + 0.5) / (a + b + 1)
            if d == depth or (context[: d + 1], place) not in nodes:
                return mass + left * p
            beta = math.exp(kt(k) + math.log(0.5) - weighted[k])
            mass, left = mass + left * beta * p, left * (1 - beta)

    for i, t in TEXTS.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in tokens[i]))
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / (len((t or "").encode()) + 1))
        if len(t or "") < 1000:
            assert r.score == pytest.approx(sum(math.log10(p if bit else 1 - p) for c, place, bit in bits(t or "") for p in [predict(c, place)]), rel=1e-6)


def test_op4_like_the_library(spark, docs):
    from tokenizers import Tokenizer, models

    reference = Tokenizer(models.Unigram(unigram.load_vocabulary(UNIGRAM_FILE), 0, True))
    got = by_id(unigram.count_tokens(docs, UNIGRAM_FILE))
    for i, t in TEXTS.items():
        want = len(reference.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
        assert got[i].n_tokens == want, i


@pytest.mark.parametrize("byte_pieces", [True, False])
def test_op4_ties_and_unknown(byte_pieces):
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256) if byte_pieces] + [("a", -1.0), ("aa", -2.0), ("ab", -1.0), ("b", -1.0), ("▁", -1.0), ("▁a", -2.0), ("aba", -2.0)]
    ours, theirs = unigram.UnigramCounter(vocabulary), Tokenizer(models.Unigram(vocabulary, 0, byte_pieces))
    rng = np.random.default_rng(2)
    for _ in range(300):
        t = "".join(rng.choice(["a", "b", " ", "z", "é", "aa"], int(rng.integers(1, 12))))
        assert ours.count(t)[0] == len(theirs.encode("▁" + t.replace(" ", "▁")).ids), t


def test_op5_like_the_library(spark, docs):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(BPE_FILE)
    got = by_id(bpe.encode_documents(docs, BPE_FILE, digests=True))
    for i, t in TEXTS.items():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), ids, sha(",".join(map(str, ids)).encode()), sha(text.encode()))
    back = by_id(bpe.decode_documents(bpe.encode_documents(docs, BPE_FILE), BPE_FILE))
    assert all(back[i].text == (t or "") for i, t in TEXTS.items())


def test_op5_random_strings():
    from tokenizers import Tokenizer

    reference, ours = Tokenizer.from_file(BPE_FILE), bpe.BytePairEncoder(BPE_FILE, cached=50)
    rng = np.random.default_rng(3)
    parts = ["a", "b", " ", "the", "ing", "\n", "  ", "é", "中", "՘", "1", "'s", "<|endoftext|>", "\U0001f600", "ᇞ0"[:1], "\x1c", "\x85", "​", "\U00011de0"]
    for t in ["".join(rng.choice(parts, int(rng.integers(0, 40)))) for _ in range(400)] + ["a" * n for n in range(70)] + ["ab" * n for n in range(30)]:
        assert ours.encode(t) == reference.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("width", [2, 5])
def test_op6(spark, docs, width):
    got = by_id(near.near_components(docs, near.Near(width=width, chunk=2)))
    sets = {}
    for i, t in TEXTS.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in TEXTS}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in TEXTS:
        for j in TEXTS:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    for i in TEXTS:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), find(i), find(i) == i), i


def test_op6_families(spark):
    """Copies with many edits: links run through members other than the first."""
    rng = np.random.default_rng(8)
    texts = []
    for family in range(4):
        base = [f"f{family}x{k}" for k in range(60)]
        for _ in range(40):
            w = list(base)
            for k in rng.choice(60, int(rng.integers(0, 9)), replace=False):
                w[k] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(near.near_components(df, near.Near(width=2, chunk=8)))
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    low = min(label[i], label[j])
                    label[i] = label[j] = low
                    changed = True
    assert [got[i].component_id for i in range(len(texts))] == label


def test_op7_counts(spark, docs):
    got = by_id(quality.judge(docs))
    for i, t in TEXTS.items():
        t = t or ""
        w = WORD.findall(t)
        places: dict = {}
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeat = {k + d for p in places.values() if len(p) > 1 for k in p for d in range(5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(repeat)), i
        assert r.base_failed == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_op7_sketches_merge(spark):
    values = spark.range(5000).select(F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("g"), (F.col("id") * F.col("id")).alias("v"))
    parts = quality.sketch(values, ["g"], ["v"])
    whole = {r.bin: r.n for r in quality.sketch(values, [], ["v"]).collect()}
    assert {r.bin: r.n for r in quality.merge(parts, []).collect()} == whole
    q = quality.quartiles(parts, ["g"]).where("g = 'x'").first()
    exact = sorted(k * k for k in range(0, 5000, 2))
    assert exact[624] * 31 / 32 <= q.q1 <= exact[625] and exact[1874] * 31 / 32 <= q.q3 <= exact[1875]


def test_op7_adapts(spark):
    """Symbols that are usual in one source are not in the other."""
    rows = [(k, "word " * 3 + ("a|b " * 9 if k % 2 else "plain text here ") + " ".join(f"u{k}x{j}" for j in range(12)), "en", f"s{k % 2}") for k in range(400)]
    rows += [(1000, "word " * 3 + "a|b " * 9 + " ".join(f"q{j}" for j in range(12)), "en", "s0")]
    got = by_id(quality.judge(spark.createDataFrame(rows, cases.SCHEMA), quality.Rules(most_repeat_percent=100)))
    assert not got[1000].kept and got[1].kept and got[2].kept


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_op8_pairs_and_distance(spark, k):
    rng = np.random.default_rng(k)
    words = sorted({"".join(rng.choice(list("abé"), int(rng.integers(1, 9)))) for _ in range(90)})
    pairs = spark.createDataFrame([(a, b) for a in words[:40] for b in words[:40]], "a string, b string")
    assert all(r.ok == (edits(r.a, r.b) <= k) for r in pairs.select("a", "b", lines.within("a", "b", k).alias("ok")).collect())
    found = lines.lines_of(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string"), 1, "doc_id", "text")
    name = {(r.h, r.g): r.line for r in found.collect()}
    got = {frozenset((name[r.h, r.g], name[r.h2, r.g2])) for r in lines.near_pairs(found, k).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if a < b and edits(a, b) <= k}


def test_op8(spark, docs):
    out = lines.dedup_lines(docs, counts=True)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"]
    got = by_id(out)
    places = [(i, n, x) for i in sorted(TEXTS) for n, x in enumerate((TEXTS[i] or "").split("\n")) if WORD.search(x)]
    for i, t in TEXTS.items():
        bad = [n for j, n, x in places if j == i and any((a, b) < (j, n) and abs(len(x) - len(y)) < 2 and (x == y or min(len(x), len(y)) >= 20 and edits(x[:200], y[:200]) <= 1 and x[200:] == y[200:]) for a, b, y in places)]
        all_ = (t or "").split("\n")
        want = None if t is None else "\n".join(x for n, x in enumerate(all_) if n not in bad)
        assert (got[i].text, got[i].n_removed) == (want, len(bad)), i


def test_op8_exempts_no_document(spark, tmp_path):
    a, b, c = ("A line of the first document, long enough.", "Quite another line that both of them have.", "And the third one, which only the last has.")
    texts = {1: f"{a}\n{b}\n--", 2: f"{a}\n{b}\n--", 3: f"{a}\n{b}\n{c}", 4: b, 5: None, 6: " "}
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in texts.items()], cases.SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(op8_line_dedup(spark, str(tmp_path)))
    want = {1: (0, texts[1]), 2: (3, ""), 3: (2, c), 4: (1, ""), 5: (0, ""), 6: (0, " ")}
    assert {i: (r.n_removed, r.kept_sha256) for i, r in got.items()} == {i: (n, sha(t.encode())) for i, (n, t) in want.items()}
    pipeline = pytest.importorskip("corpus_pipeline")
    left = by_id(pipeline.line_dedup(spark, docs, str(tmp_path)))
    assert {i: r.text for i, r in left.items()} == {1: texts[1], 3: c, 5: None, 6: " "}


def test_op8_rows_of_one_id(spark):
    """A line kept in one row of an id is not kept for it in another; rows equal in id and text are one document."""
    a, b = "The line that stands in three of these rows.", "Another text altogether, met once alone."
    rows = [(1, a), (2, b), (2, a), (None, a + "\n" + b + "!"), (None, "x\n" + a), (3, "x"), (4, "x y\nx"), (4, "x y\nx")]
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()))
    # Null ids come first, by the hash of their texts; the first of them keeps both lines that others repeat.
    order = [r.text for r in spark.createDataFrame([(x,) for i, x in rows if i is None], "text string").orderBy(F.xxhash64("text")).collect()]
    seen, want = [], []
    for i, text in [(0, x) for x in order] + [(1, a), *sorted([(2, b), (2, a)], key=lambda r: 0), (3, "x"), (4, "x y\nx"), (4, "x y\nx")]:
        kept = [x for x in text.split("\n") if not any(x == y or min(len(x), len(y)) >= 20 and edits(x, y) <= 1 for y in seen)]
        if i != 4 or not any(w[0] == 4 for w in want):
            seen += text.split("\n")
            want.append((i, "\n".join(kept), len(text.split("\n")), len(text.split("\n")) - len(kept)))
        else:
            want.append(want[-1])
    assert got == sorted(want)


def filled(nodes, given):
    """Shares of a family by plain loops: nodes that fill up before their fair part go first, the others share what is left by weight."""
    left, open_, out = given, dict(nodes), {}
    while open_:
        weights = sum(w for _, w in open_.values())
        full = [n for n, (c, w) in open_.items() if c * weights <= left * w]
        if not full:
            return out | {n: max(left * w // weights, 0) for n, (_, w) in open_.items()}
        n = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        out[n] = open_.pop(n)[0]
        left -= out[n]
    return out


def test_op9_shares(spark):
    rng = np.random.default_rng(6)
    for _ in range(6):
        nodes = {f"n{k}": (int(rng.integers(0, 200)), int(rng.integers(1, 5))) for k in range(int(rng.integers(1, 7)))}
        given = int(rng.integers(0, 500))
        df = spark.createDataFrame([(n, w, c, given) for n, (c, w) in nodes.items()], "name string, weight long, capacity long, _given long")
        assert {r.name: r.given for r in mixing.share(df, [F.lit(0)]).collect()} == filled(nodes, given)


def test_op9(spark, docs):
    decided, leaves = mixing.plan(docs, {"lang": {"en": 3}}, part_percent=60, epochs=2)
    table = leaves.collect()
    assert sum(r.given for r in table) <= sum(r.tokens for r in table) * 60 // 100
    assert all(r.given <= r.capacity for r in table)
    got = decided.collect()
    assert sorted(r.doc_id for r in got) == sorted(TEXTS) and all(0 <= r.copies <= 2 for r in got)
    for leaf in table:
        own = sorted((r.order, r.doc_id, r.n_tokens, r.copies) for r in got if (r._domain, r._lang, r._source) == (leaf._domain, leaf._lang, leaf._source))
        left = leaf.rest
        for _, _, n, copies in own:
            fits = leaf.rest > 0 and left >= n
            assert copies == leaf.whole + fits
            left = left - n if fits else -1
    out = mixing.mix(docs, {}, part_percent=60, epochs=2)
    assert out.columns == docs.columns
    decided, _ = mixing.plan(docs, {}, part_percent=60, epochs=2)
    assert Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: r.copies for r in decided.collect() if r.copies})


def test_op9_shortage_goes_to_siblings_first(spark):
    rows = [(k, "a b c d e", "en", "s1") for k in range(2)] + [(10 + k, "a b c d e", "en", "s3") for k in range(40)] + [(100 + k, "a b c d e", "de", "s1") for k in range(40)]
    _, leaves = mixing.plan(spark.createDataFrame(rows, cases.SCHEMA), {}, part_percent=50, epochs=1)
    given = {(r._lang, r._source): r.given for r in leaves.collect()}
    # 205 tokens: half for each language; s1 of en holds 10 of its 51, the rest of the English half goes to s3.
    assert given["en", "s1"] == 10 and given["en", "s3"] == 92 and given["de", "s1"] == 102


def test_op10(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in rng.normal(size=8)], k) for k in range(300)]
    rows += [(300 + k, [0.5] * 8, 0) for k in range(60)]  # ties
    rows += [(400, None, 0), (420, [1.0, None] + [0.0] * 6, 0), (440, [float("nan")] * 8, 0), (460, [float("inf")] * 8, 0), (480, [], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int")
    got: dict = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, topk.Search(k=20, pivots=7, queries=5, block=40)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = {i: np.floor(64 * np.array([np.float32(x) for x in v], float)).astype(int) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in vectors if i % 20 == 0]:
        dims = len(vectors[q])
        scored = sorted((-int(vectors[q][: len(v)] @ v[:dims] if dims else 0), i) for i, v in vectors.items() if i != q)
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored[:20])]
    assert set(got) == {i for i in vectors if i % 20 == 0}


def test_op10_rows_of_one_id(spark):
    """Every row of a query's id has its own neighbours: all rows but itself."""
    rows = [(0, [1.0, 2.0])] * 2 + [(0, [-1.0, 1.0])] + [(k, [float(k % 7), float(k % 5)]) for k in range(1, 40)] + [(20, [3.0, 3.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), F.col("vec_id") % 20 == 0, topk.Search(k=20, pivots=3, block=16)).collect())
    v = [(i, np.array(x) * 64) for i, x in rows]
    want = []
    for n, (i, x) in enumerate(v):
        if i % 20 == 0:
            scored = sorted((-int(x @ y), j) for m, (j, y) in enumerate(v) if m != n)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert got == sorted(want) and len(got) == 100


@pytest.mark.parametrize("size", [3e17, 1e150, 1e300])
def test_op10_large_components(spark, size):
    rows = [(k, [size * (k + 1), 1.0, -size * (k % 3)]) for k in range(60)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, topk.Search(k=20, pivots=4)).collect())
    v = {k: [math.floor(64 * c) for c in x] for k, x in rows}
    last, want = (1 << 63) - 1, []
    for q in (0, 20, 40):
        scored = sorted((-max(-last, min(last, sum(a * b for a, b in zip(v[q], v[k])))), k) for k in v if k != q)[:20]
        want += [(q, r + 1, k, -s) for r, (s, k) in enumerate(scored)]
    assert got == sorted(want)


def test_empty_tables(spark):
    e = cases.empty(spark)
    assert substrings.remove_repeats(e).count() == 0
    assert suffixes.remove_repeats(e).count() == 0
    assert ctw.score(e).count() == 0
    assert unigram.count_tokens(e, UNIGRAM_FILE).count() == 0
    assert bpe.encode_documents(e, BPE_FILE).count() == 0
    assert near.near_components(e).count() == 0
    assert quality.judge(e).count() == 0
    assert lines.dedup_lines(e).count() == 0
    assert mixing.mix(e, {}).count() == 0
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_rows_repeated_and_null_ids(spark):
    """Every row has a result."""
    rows = [(1, cases.passage(3, 60), "en", "a")] * 2 + [(None, cases.passage(4, 60), "en", "a"), (2, None, "en", "a")]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    for out in (substrings.remove_repeats(df), suffixes.remove_repeats(df), ctw.score(df), bpe.encode_documents(df, BPE_FILE), near.near_components(df), quality.judge(df), lines.dedup_lines(df), unigram.count_tokens(df, UNIGRAM_FILE)):
        assert out.count() == 4


def test_rows_of_one_id_and_null_ids_by_value(spark):
    """Rows that share an id or have none are documents of their own if their texts differ."""
    long, other = cases.passage(5, 80), cases.passage(9, 50)
    rows = [(1, "short"), (1, long), (2, long), (None, other), (7, other), (None, "short"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == sorted([(1, 1, 0), (1, 80, 80), (2, 80, 80), (0, 50, 50), (7, 50, 50), (0, 1, 0), (0, 0, 0)])
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    n, m = len(long), len(other)
    assert got == sorted([(1, 5, 0), (1, n, 0), (2, n, n), (0, m, 0), (7, m, m), (0, 5, 0), (0, 0, 0)])
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near.near_components(df, near.Near(width=2)).collect())
    sizes = {t: len(set(zip(t.split(), t.split()[1:]))) for t in (long, other)}
    assert got == sorted([(1, 1, 1, True), (1, sizes[long], 1, True), (2, sizes[long], 1, False), (0, sizes[other], 0, True), (7, sizes[other], 7, True), (0, 1, 0, True), (0, 0, 0, True)])
    same = spark.createDataFrame([(3, long)] * 2, "doc_id long, text string")
    assert [r.n_removed for r in suffixes.remove_repeats(same).collect()] == [0, 0]  # one document read twice
    assert [r.n_removed for r in substrings.remove_repeats(same).collect()] == [80, 80]


def test_filters_keep_columns(spark, docs):
    assert quality.keep_good(docs).columns == docs.columns
    assert near.drop_near(docs).columns == docs.columns
    assert {r.doc_id for r in near.drop_near(docs, near.Near(width=2)).collect()} == set(TEXTS) - {2, 3, 10}


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline") if os.path.exists(os.path.join(os.path.dirname(__file__), "..", "..", "corpus_pipeline.py")) else pytest.skip("no pipeline")
    from pyspark.sql.types import LongType

    docs = spark.createDataFrame(cases.rows(), cases.SCHEMA).withColumn("n_chars", F.length("text").cast(LongType()))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in pipeline.STAGES[:-1]:
        before = left.count()
        out = stage(spark, left, str(tmp_path))
        assert out.columns == columns, name
        path = f"{tmp_path}/{name.replace(' ', '-')}"
        out.write.parquet(path)
        left = spark.read.parquet(path)
        assert left.count() <= before
    ids = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert ids == {r.doc_id for r in left.collect()} and not ids & {2, 6, 7, 8, 11}


def quality_by_hand(rows):
    """Ids that the quality stage keeps: base rules and fences from binned shares, by plain loops."""
    import corpus_pipeline as pipeline

    rules, found = quality.Rules(least_words=pipeline.LEAST_WORDS), {}
    for i, t, lang, source in rows:
        t, w = t or "", WORD.findall(t or "")
        places: dict = {}
        for k in range(len(w) - 4):
            places.setdefault(tuple(w[k : k + 5]), []).append(k)
        repeat = len({k + d for p in places.values() if len(p) > 1 for k in p for d in range(5)})
        chars = sum(map(len, w))
        value = {"symbol_rate": 10000 * sum(t.count(c) for c in "#*$%&|<>") // len(w), "upper_rate": 10000 * len(re.findall("[A-Z]", t)) // chars, "mean_length": 1000 * chars // len(w)} if w else {}
        found[i] = (lang or "", source or "", value, len(w) < rules.least_words or 100 * repeat > rules.most_repeat_percent * len(w))

    def fence(lang, source, m):
        for group in ((lang, source), (lang,), ()):
            bins = sorted(v[m] - v[m] % (1 << max(v[m].bit_length() - 6, 0)) for x, y, v, _ in found.values() if m in v and (x, y)[: len(group)] == group)
            if len(bins) >= rules.least_docs or (bins and not group):
                return bins[-(-len(bins) // rules.parts) - 1], bins[-(-(rules.parts - 1) * len(bins) // rules.parts) - 1]

    kept = set()
    for i, (lang, source, value, failed) in found.items():
        good = not failed
        for m in rules.measures:
            if m in value:
                q1, q3 = fence(lang, source, m)
                reach = rules.spread * max(q3 - q1, q3 // 16, 1)
                good &= value[m] <= q3 + reach and not (m in rules.two_sided and value[m] < q1 - reach)
        if good:
            kept.add(i)
    return kept


def test_pipeline_stages_by_hand(spark, tmp_path):
    """Each stage on what its predecessor kept, against plain loops."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = cases.rows() + [(20 + k, f"line of document {k} that is its own\n" + cases.passage(30 + k, 40) + ("\n#### $$$$" * 30 if k == 7 else ""), "en", f"s{k % 3}") for k in range(60)]
    docs = spark.createDataFrame(rows, cases.SCHEMA)
    left = {r.doc_id: r for r in pipeline.quality_rules(spark, docs, "").collect()}
    assert set(left) == quality_by_hand(rows) and 27 not in left
    docs = spark.createDataFrame([tuple(r) for r in left.values()], cases.SCHEMA)
    lines_left = {r.doc_id: r.text for r in pipeline.line_dedup(spark, docs, "").collect()}
    want, seen, whole = {}, [], {}
    for i in sorted(left):
        kept = []
        for x in left[i].text.split("\n"):
            part = WORD.search(x)
            if not (part and any(abs(len(x) - len(y)) < 2 and (x == y or min(len(x), len(y)) >= 20 and edits(x, y) <= 1) for y in seen)):
                kept.append(x)
            if part:
                seen.append(x)
        if whole.setdefault(left[i].text, i) == i and WORD.search("\n".join(kept)):
            want[i] = "\n".join(kept)
    assert lines_left == want
    docs = spark.createDataFrame([(i, t, left[i].lang, left[i].source) for i, t in want.items()], cases.SCHEMA)
    sets = {}
    for i, t in want.items():
        w = WORD.findall(t.translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    group = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()} == {i for i, g in group.items() if i == g}
    sizes = {i: len(WORD.findall(t)) for i, t in want.items()}
    budget = sum(sizes.values()) * pipeline.MIX_PERCENT // 100
    leaf: dict = {}
    for i in want:
        source = left[i].source or ""
        domain = "other" if not re.search("[0-9]$", source) else "web" if source[-1] in "02468" else "books"
        leaf.setdefault(domain, {}).setdefault(left[i].lang or "", {}).setdefault(source, []).append(i)
    taken = set()
    total = lambda node: sum(map(total, node.values())) if isinstance(node, dict) else sum(sizes[i] for i in node)
    for domain, share in filled({d: (total(x), 1) for d, x in leaf.items()}, budget).items():
        for lang, part in filled({n: (total(x), pipeline.MIX_WEIGHTS["lang"].get(n, 1)) for n, x in leaf[domain].items()}, share).items():
            for source, own in filled({n: (total(x), 1) for n, x in leaf[domain][lang].items()}, part).items():
                ids = sorted(leaf[domain][lang][source], key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest(), i))
                if own == total(ids):
                    taken |= set(ids)
                    continue
                for i in ids:
                    if own <= 0 or sizes[i] > own:
                        break
                    own -= sizes[i]
                    taken.add(i)
    assert {r.doc_id for r in pipeline.mix_sources(spark, docs, "").collect()} == taken
