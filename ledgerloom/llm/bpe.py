"""Byte-level BPE encoding by a dynamic program over prefixes, and decoding.

Every prefix of a piece has exactly one correct encoding, so it has one last token. For each prefix, from short to long,
the vocabulary entries that end there are enumerated by an automaton with suffix links; the one that may follow the last
token of the prefix before it (the pair encodes to itself) is stored. Back-pointers from the whole piece give the ids.
Results equal those of the ``tokenizers`` library for the same file.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The pre-tokenizer's pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
# The same pattern for texts within U+00FF, for the faster standard module.
LATIN_PATTERN = rf" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairEncoder:
    """Encoder and decoder for one vocabulary file. Pieces met before are kept, up to ``cached`` of them."""

    def __init__(self, path: str, cached: int = 800_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = byte_alphabet()
        vocab = {k: v for k, v in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            whole = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = k
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (vocab[left], vocab[right]), k
        self.ends = ahocorasick.Automaton()
        for i in vocab.values():
            if self.bytes_of[i] and (i in self.parts or len(self.bytes_of[i]) == 1):
                self.ends.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.ends.make_automaton()
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.path, self.cached = path, cached
        self.digits = {i: str(i) for i in self.bytes_of}
        self.ids: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._plain, self._wide = re.compile(LATIN_PATTERN), None

    def follows(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is what their joined bytes encode to."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 500_000:
                self.fits.clear()
            known = self.fits[left, right] = self._follows(left, right)
        return known

    def _follows(self, left: int, right: int) -> bool:
        # Undo the merges of both tokens, the later one first. While both sides are still whole at some moment, a merge across
        # the border of an earlier rank than the merge being undone would have come first, and the pair could not stay.
        rank, made, parts = self.rank, self.made, self.parts
        before = 1 << 62  # merges of a smaller rank have been made at this moment
        a, b = left, right  # the tokens at the border then
        while True:
            across = rank.get((a, b))
            if across is not None and across < before:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            # At equal ranks (the same token twice) the left one is merged first, so the right one is undone first.
            if ra > rb:
                # The merge across has to be strictly earlier than this merge, or of the same rank and further left.
                before, a = ra, parts[a][1]
            else:
                before, b = rb + 1, parts[b][0]

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        last: list[tuple[int, int] | None] = [None] * (len(data) + 1)
        for end, (size, token) in self.ends.iter(data.decode("latin-1")):
            end += 1
            if last[end] is not None:
                continue
            start = end - size
            if start == 0 or (last[start] is not None and self.follows(last[start][1], token)):
                last[end] = (start, token)
        out, at = [], len(data)
        while at:
            at, token = last[at]
            out.append(token)
        return tuple(reversed(out))

    def _pieces(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return self._plain.findall(text)
        except UnicodeEncodeError:
            if self._wide is None:
                self._wide = regex.compile(_older_classes(self.path), regex.V1)
            return self._wide.findall(text)

    def _look(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        ids = self.ids
        try:
            return list(map(ids.__getitem__, pieces))
        except KeyError:
            pass
        if len(ids) > self.cached:
            ids.clear()
        for p in pieces:
            if p not in ids:
                ids[p] = self.piece(p)
        return map(ids.__getitem__, pieces)

    def encode(self, text: str) -> list[int]:
        if self.split_special is None or not any(s in text for s in self.special):
            return list(chain.from_iterable(self._look(self._pieces(text))))
        out: list[int] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(chain.from_iterable(self._look(self._pieces(part))))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _older_classes(path: str) -> str:
    """The pattern with the letters and numbers that the tokenizers library knows.

    The ``regex`` module may know a later Unicode version, in which some code points have become letters; the library's own
    pre-tokenizer is asked about every code point that this Python's Unicode tables don't assign.
    """
    import unicodedata

    from tokenizers import Tokenizer

    asked = Tokenizer.from_file(path).pre_tokenizer
    newer = regex.compile(r"[\p{L}\p{N}]")
    later = [c for c in map(chr, chain(range(0xD800), range(0xE000, 0x110000))) if unicodedata.category(c) == "Cn" and newer.match(c)]
    later = [c for c in later if len(asked.pre_tokenize_str("!" + c)) == 1]
    if not later:
        return PATTERN
    runs: list[list[int]] = []
    for c in map(ord, later):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    out = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in runs)
    letters, numbers = rf"[\p{{L}}--[{out}]]", rf"[\p{{N}}--[{out}]]"
    other = rf"[[^\s\p{{L}}\p{{N}}]||[{out}]]"
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+| ?{other}+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """One encoder for each Python worker and file."""
    return BytePairEncoder(path)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """``id_col``, ``n_tokens`` and, as asked for, ``ids`` (array of int), ``ids_sha256`` and ``decoded_sha256`` of each document.

    One row for each input row, repeated ids included; a null text counts as empty (no tokens, digests of the empty string).
    Nothing is shuffled; a task holds one Arrow batch of texts.
    """
    kinds = dict(docs.dtypes)
    schema = f"`{id_col}` {kinds[id_col]}, n_tokens long" + ", ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                out: dict[str, list] = {"n": [], "ids": [], "a": [], "b": []}
                for text in part.column(1).to_pylist():
                    got = code.encode(text or "")
                    out["n"].append(len(got))
                    if ids:
                        out["ids"].append(got)
                    if digests:
                        out["a"].append(_sha(",".join(map(code.digits.__getitem__, got)).encode()))
                        out["b"].append(_sha(code.decode(got).encode("utf-8")))
                columns = [part.column(0), pa.array(out["n"], pa.int64())]
                columns += [pa.array(out["ids"], pa.list_(pa.int32()))] * ids + [pa.array(out["a"], pa.string()), pa.array(out["b"], pa.string())] * digests
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", *["ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` from arrays of ids; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            got = [None if x is None else code.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {dict(encoded.dtypes)[id_col]}, text string")
