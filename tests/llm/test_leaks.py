"""Secret scans against the contract's patterns as they stand, and random strings against a direct count of tokens."""

import base64
import hashlib
import random
import re
import string

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from ledgerloom.llm import leaks
from ledgerloom.llm.queries import op13_secret_scan

from . import cases

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def texts():
    rng = random.Random(9)
    alphabet = string.ascii_letters + string.digits

    def word(n, some=alphabet):
        return "".join(rng.choices(some, k=n))

    out = {r[0]: r[1] for r in cases.rows()}
    secrets = {}
    for k in range(100):
        text = word(40)
        secrets[100 + k] = text
        out[100 + k] = f"{cases.passage(k, 9)} é\U0001f600 {text}, {cases.passage(k + 2, 20)}"
    clean = [
        hashlib.md5(b"x").hexdigest(), "sha256-" + base64.b64encode(hashlib.sha256(b"x").digest()).decode(), "md5:" + hashlib.md5(b"y").hexdigest().upper(), "550e8400-e29b-41d4-a716-446655440000",
        "getUserAccountNameFromDatabaseIndex", "report-2007-12-27-v5-final-2-of-3", "4225039295678253", "1234-5678-9012-3456-7890-1234", "an_identifier_of_many_words_2", "ANTHRERERENDANHEWORDS", "x" * 90,
        "=" * 60, "https://example.com/fr/825/page/2/of/many/parts/here",
    ]
    for k, text in enumerate(clean):
        out[300 + k] = f"{cases.passage(k, 4)} {text} {cases.passage(k, 3)}"
    odd = [
        "token:token:abcdef", "Password = 'hunter2x' passwd:abc SECRET=\"a.b-c/d+e\"", "api_key=  k12345 apikey :zzzzz", "ſecret=abcdefgh toKen=abcdefgh", "AKIA" + "A" * 15 + " AKIAAKIA" + "Z" * 12 + " xAKIA" + "9" * 16,
        "a" * 23 + " " + "b" * 24 + "g" + "c" * 30, "token=" + "f" * 40, "token = \n abcdefgh", "AKIA" + word(30, string.ascii_uppercase) + word(9, string.ascii_lowercase) + word(20), word(5000), "token=" + word(40) + "  " + word(44),
    ]
    for k, text in enumerate(odd):
        out[400 + k] = text
    return out, secrets


def test_query(spark, tmp_path):
    rows, secrets = texts()
    spark.createDataFrame(list(rows.items()) + [(None, "token=abcdefg")], "doc_id long, text string").withColumn("spans", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + 1
    code = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    for i, text in (rows | {None: "token=abcdefg"}).items():
        text, r = text or "", got[i]
        want = base(text)
        joined = ",".join(f"{leaks.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        spans = [(int(a), leaks.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert spans == sorted(spans) and [x for x in spans if x[1] < 3] == want
        for a, _, b in (x for x in spans if x[1] == 3):
            assert (b - a) < 2.0 * len(code.encode_ordinary(text[a:b]))
            assert all(b <= x or y <= a for x, _, y in want)
    for i, text in secrets.items():
        assert "random" in got[i].spans and rows[i][int(got[i].spans.split(":")[1]) :].startswith(text)
    for i in [r[0] for r in cases.rows()] + list(range(300, 313)):
        assert "random" not in got[i].spans
    assert got[409].spans == "random:0:5000"
    assert got[410].spans.split(",")[1] == f"random:{len('token=') + 42}:{len('token=') + 86}"


def test_whole_tokens_of_long_strings():
    text = "".join(random.Random(1).choices(string.ascii_letters, k=3000))
    assert leaks.count_tokens(text, PATH) >= len(leaks.encoding(PATH).encode_ordinary(text))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a token=abcdefg b", 1), (2, None, 2), (3, "clean", 3), (4, "token=" + "f" * 40 + " x", 4)], "doc_id long, text string, spans long")
    assert {r.doc_id: (r.text, r.spans) for r in leaks.redact(docs, PATH).collect()} == {1: ("a [secret] b", 1), 2: (None, 2), 3: ("clean", 3), 4: ("[secret] x", 4)}
    assert leaks.find_secrets(cases.empty(spark), PATH).collect() == []
