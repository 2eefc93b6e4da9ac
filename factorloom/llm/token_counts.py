"""Count-only Viterbi segmentation with a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic
programming over end positions keeps only the best score and its number of
tokens, never the pieces.  Ties follow the tokenizer's rule: starts are tried
from left to right and a later one must score strictly more, so of equal
segmentations the one whose last piece is longest wins.  A character that no
single piece matches costs the lowest score less ten, and counts as its UTF-8
bytes where the vocabulary has byte pieces, else as one unknown (neighbouring
unknowns are one).

No piece has a space mark behind another character, so every best segmentation
breaks before a run of space marks: a text falls into units (spaces and a
word), and a unit's count is made once and remembered.

Defined results: a null or empty text has no tokens; rows are counted one by
one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: The mark that stands for a space, and what unknown characters cost beside the lowest score.
MARK, UNKNOWN = "▁", 10.0
REMEMBERED = 400_000


class UnigramCounter:
    """Token counts of texts for pieces with scores; byte pieces are written ``<0x00>`` to ``<0xFF>``."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.low = min(s for _, s in pieces) - UNKNOWN
        self.find = ahocorasick.Automaton()
        best: dict[str, float] = {}
        for p, s in pieces:
            if p:
                best[p] = s
        for p, s in best.items():
            self.find.add_word(p, (len(p), s))
        self.find.make_automaton()
        self.inner = any(MARK in p.lstrip(MARK) for p in best)
        self.known: dict[str, int] = {}

    def viterbi(self, unit: str) -> int:
        """Tokens of the best segmentation of a text whose spaces are marked."""
        n = len(unit)
        score, count, unknown = [0.0] + [-math.inf] * n, [0] * (n + 1), [False] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        single = [False] * n
        for last, (size, s) in self.find.iter(unit):
            ends[last + 1].append((last + 1 - size, s))
            if size == 1:
                single[last] = True
        for end in range(1, n + 1):
            best, at, new = -math.inf, -1, False
            for start, s in sorted(ends[end]):
                if score[start] + s > best or at < 0:
                    best, at = score[start] + s, start
            if not single[end - 1] and (at < 0 or score[end - 1] + self.low > best):
                best, at, new = score[end - 1] + self.low, end - 1, True
            score[end], unknown[end] = best, new
            if not new:
                count[end] = count[at] + 1
            elif self.bytes:
                count[end] = count[at] + len(unit[at].encode("utf-8", "surrogatepass"))
            else:
                count[end] = count[at] + (not unknown[at])
        return count[n]

    def unit(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.viterbi(word)
            if len(self.known) < REMEMBERED and len(word) < 64:
                self.known[word] = n
        return n

    def __call__(self, text: str) -> int:
        """Tokens of a text; it is marked as it stands, without a mark before its first word."""
        if self.inner or not self.bytes or MARK in text:  # units would not be independent
            return self.viterbi(text.replace(" ", MARK))
        parts = text.split(" ")
        total = self.unit(parts[0]) if parts[0] else 0
        spaces, unit = 0, self.unit
        for part in parts[1:]:
            spaces += 1
            if part:
                total += unit(MARK * spaces + part)
                spaces = 0
        return total + (unit(MARK * spaces) if spaces else 0)


def sentencepiece_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public sentencepiece file, its control pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]


_counters: dict[str, UnigramCounter] = {}


def _counts(path: str):
    def run(batches):
        if path not in _counters:
            _counters[path] = UnigramCounter([(p, s) for p, s in sentencepiece_vocabulary(path)])
        counter = _counters[path]
        for batch in B.blocks(batches):
            texts = [x or "" for x in B.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([B.column(batch, "doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([counter(x) for x in texts], pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_chars, n_tokens) for every row; ``vocabulary`` is a sentencepiece file that workers can open."""
    B.bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(B.tidied(_counts(vocabulary)), "doc_id long, n_chars long, n_tokens long")
