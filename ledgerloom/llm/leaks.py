"""Secret scans: three base patterns, and a token-efficiency test for random strings that no pattern knows.

A tokenizer's vocabulary covers what people write with few tokens; a random string has hardly any piece in it, so its tokens hold few characters each. What is known to look like
that without being secret (digests, ids, numbers, names) is taken out first.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
#: Kind, pattern, group that is measured and the characters it has to have.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # runs are maximal: those that fall short need not match
)
#: What encoders of random bytes write.
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]+")
#: Digests: hexadecimal ones of the usual lengths, and base64 ones that name their function.
DIGEST = re.compile(r"(?:(?:md5|sha\d+)[-_=/])?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|sha(?:1|256|384|512)-[A-Za-z0-9+/_-]{27,86}={0,2}")
#: Identifiers: UUIDs, numbers in groups, and words that are joined, each with a number behind it or not.
IDENTIFIER = re.compile(r"(?:urn-|uuid-)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9+/=_-]+|(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,4}|\d{1,4})(?:[+/=_-]+(?:(?:[A-Z]?[a-z]+|[A-Z]+)\d{0,4}|\d{1,4}))*[+/=_-]*")
_PART = 1024  # characters that are encoded at once


@dataclass(frozen=True)
class Leaks:
    """``least`` characters make a candidate; below ``ratio`` characters a token it is random. ``changes`` from one class (lower, upper, digit, other) to another
    are the least a random string shows: names in mixed case have fewer."""

    least: int = 20
    ratio: float = 2.0
    changes: int = 5


@lru_cache(maxsize=2)
def encoding(path: str):
    """One encoding for each Python worker and vocabulary file."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("scan", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Tokens of ``text``, encoded in parts of 1024 characters, so that a long string costs no more than its length."""
    code = encoding(path)
    return sum(len(code.encode_ordinary(text[k : k + _PART])) for k in range(0, len(text), _PART))


_CLASS = str.maketrans({c: k for k, some in (("a", "abcdefghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "0123456789"), ("-", "+/=_-")) for c in some})
_RUNS = re.compile(r"(.)\1*")


def is_random(text: str, path: str, rules: Leaks) -> bool:
    """Whether a string is neither digest nor identifier, mixes classes of characters, and has few characters a token."""
    if len(text) < rules.least or DIGEST.fullmatch(text) or IDENTIFIER.fullmatch(text):
        return False
    if len(_RUNS.findall(text.translate(_CLASS))) <= rules.changes:
        return False
    return len(text) < rules.ratio * count_tokens(text, path)


def spans_of(text: str, path: str, rules: Leaks) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), sorted, in code points. The base patterns' leftmost matches, without those that are too short, and random strings that meet none of them."""
    found = [(m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    found.sort()
    more, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        if m.end() - m.start() < rules.least:
            continue
        while at < len(found) and found[at][0] < m.end():
            reach = max(reach, found[at][2])
            at += 1
        if reach <= m.start() and is_random(m.group(), path, rules):
            more.append((m.start(), len(BASE), m.end()))
    return sorted(found + more)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, path: str, rules: Leaks = Leaks(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array of kind, start and end (code points, end exclusive), by start, then kind.

    One row for each input row, repeated ids included; a null or empty text has no spans. ``path`` names a tiktoken vocabulary. Nothing is shuffled; a task holds an Arrow batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(text or "", path, rules)] for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _SPANS)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {dict(docs.dtypes)[id_col]}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, path: str, rules: Leaks = Leaks(), text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with ``mark`` in place of every span (of each stretch that spans cover together); all columns stay, nulls too."""

    def clean(text: str) -> str:
        out, at, last = [], 0, -1
        for start, _, end in spans_of(text, path, rules):
            if start >= at or last < 0:
                out += [text[at:start], mark]
            at = last = max(at, end)
        return "".join(out) + text[at:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else clean(t) for t in batch.column(text_col).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(texts, batch.schema.field(text_col).type))

    return docs.mapInArrow(scan, docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, SHA-256 of the base spans and all spans as one text."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select(id_col, *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
