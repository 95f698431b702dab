"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary entries that end at each character; a dynamic program carries, for each
position, the best score and its piece count. Of equal scores the path whose last piece starts first stays, as in the
``tokenizers`` library's Unigram model. No pieces are emitted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"  # stands for a space, and begins the text
UNKNOWN_PENALTY = 10.0  # a character without an entry scores this much below the lowest entry


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in the order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class UnigramCounter:
    """Counts the pieces of the best segmentation. Segments met before are kept, up to ``cached`` of them."""

    def __init__(self, vocabulary: list[tuple[str, float]], cached: int = 800_000):
        self.bytes = {f"<0x{b:02X}>" for b in range(256)} <= {piece for piece, _ in vocabulary}
        special = {"<unk>", "<s>", "</s>"} | {f"<0x{b:02X}>" for b in range(256)}
        scored = [(piece, score) for piece, score in vocabulary if piece and piece not in special]
        self.lowest = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.ends = ahocorasick.Automaton()
        for piece, score in scored:
            self.ends.add_word(piece, (len(piece), score))
        self.ends.make_automaton()
        # A piece has its marks in front only, so a best path has a border before each mark that follows another character.
        self.cuts = all(MARK not in piece.lstrip(MARK) for piece, _ in scored)
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.cached, self.known = cached, {}

    def segment(self, text: str) -> tuple[int, int, float]:
        """Pieces, unknown characters among them, and score of ``text``."""
        n = len(text)
        score: list[float | None] = [0.0] + [None] * n
        start, count = [0] * (n + 1), [0] * (n + 1)
        unknown = [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.ends.iter(text):
            ends[end + 1].append(found)
        for end in range(1, n + 1):
            best, single = None, False
            for size, value in sorted(ends[end], reverse=True):  # the longest first: the first start keeps a tie
                single |= size == 1
                s = score[end - size] + value
                if best is None or s > best:
                    best, start[end], bad = s, end - size, 0
            if not single and (best is None or score[end - 1] + self.lowest > best):
                best, start[end], bad = score[end - 1] + self.lowest, end - 1, 1
            score[end] = best
            unknown[end] = unknown[start[end]] + bad
            if not bad:
                count[end] = count[start[end]] + 1
            elif self.bytes:  # an unknown character is written as its bytes
                count[end] = count[start[end]] + len(text[end - 1].encode())
            else:  # unknown characters in a row are one piece
                follows = end > 1 and start[end - 1] == end - 2 and unknown[end - 1] > unknown[end - 2]
                count[end] = count[start[end]] + (not follows)
        return count[n], unknown[n], score[n] or 0.0

    def count(self, text: str) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        text = MARK + text.replace(" ", MARK)
        if not self.cuts or not self.bytes:
            return self.segment(text)
        known, parts = self.known, self.segments.findall(text)
        if len(known) > self.cached:
            known.clear()
        for part in parts:
            if part not in known:
                known[part] = self.segment(part)
        counts, bad, scores = zip(*map(known.__getitem__, parts))
        return sum(counts), sum(bad), sum(scores)


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(load_vocabulary(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_unknown`` (characters written as bytes) and ``score`` (of the best path) of each document.

    One row for each input row; a null or empty text has no tokens and score 0. Spaces become marks, one mark begins the text,
    and nothing else is normalised. Nothing is shuffled.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = counter(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                got = [code.count(text or "") for text in part.column(1).to_pylist()]
                n, bad, score = zip(*got)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(bad, pa.int64()), pa.array(score, pa.float64())], names=[id_col, "n_tokens", "n_unknown", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_unknown long, score double")
