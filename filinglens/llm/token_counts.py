"""Token counts under a unigram vocabulary, by count-only Viterbi.

The vocabulary is the pieces and scores of a sentencepiece model file, read as a
unigram model. An Aho-Corasick automaton lists every vocabulary match of a
stretch of text; dynamic programming over the ends of matches carries the best
score and the number of pieces, and nothing else: no segmentation is built.

Rules of the library, kept exactly:
- a space becomes U+2581, and one is put before a non-empty text;
- matches are tried by start, then by length; a later one replaces an earlier
  only if its sum is strictly greater, so ties go to the earliest start;
- a character without a piece of its own costs the least score minus 10 and counts
  as its UTF-8 bytes where the model falls back to bytes, else as one;
- whole-number scores are summed exactly, as the library sums them while they fit its 24 bits;
- other scores (log-probabilities) are summed in 32-bit floats from the start of the
  text, a text being one chain; where the best sum falls below ``REBASE``, it is taken
  off it and the open ends, as the library does. Rounding decides near ties.

Some files give their runs of spaces a score near minus infinity (``SENTINEL`` or
less), beside which every other score is lost to the library's rounding. ``load``
lifts such scores to one less than the least real score, and the results are those
of the library under the vocabulary so lifted.

No piece joins a space to what stands before it, so a text falls into stretches
(spaces and the word after them) whose counts add up where sums are exact. The counts
of up to ``MEMORY`` stretches are remembered per task.

Matches come by their end, longest first, and are used at once; of the sums, only as
many as the longest piece has characters are kept. Memory does not grow with a stretch.

A model whose normaliser rewrites characters, folds spaces or adds no space in front is
refused, as are user-defined pieces.

A null or empty text has 0 tokens. Texts are whole, of any length; repeated rows
are counted per row; extra columns are ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from filinglens.llm import text as tx

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MEMORY = 600_000
SPACE = "▁"
UNKNOWN_PENALTY = 10
SENTINEL = -(10**8)
REBASE = -100_000.0  # fixed value
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class Vocabulary(NamedTuple):
    """Pieces with scores (whole numbers, or values of 32-bit floats), the score of an unknown character, and the byte fallback."""

    scores: dict[str, int | float]
    unknown: int | float
    bytes_fallback: bool

    @property
    def exact(self) -> bool:
        return isinstance(self.unknown, int)


def _single(x: int | float) -> int | float:
    """The nearest 32-bit float; whole numbers stay exact."""
    return x if isinstance(x, int) else float(np.float32(x))


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def load(path: str = VOCABULARY) -> Vocabulary:
    """Normal pieces (kind 1) of a model file; its control, unknown and byte pieces match no text."""
    import struct

    with open(path, "rb") as file:
        data = file.read()
    scores, fallback = {}, False
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            if piece.get(3, 1) == 1:
                scores[piece[1].decode()] = score
            elif piece[3] in (4, 5):
                raise ValueError("user-defined and unused pieces are not supported")
        elif field == 2:
            fallback = bool(dict(_fields(value)).get(35, 0))
        elif field == 3:
            normaliser = dict(_fields(value))
            if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1):
                raise ValueError("the model's normaliser changes texts")
    if not scores:
        raise ValueError("the model has no pieces")
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError("a piece joins a space to what stands before it")
    least = min((v for v in scores.values() if v > SENTINEL), default=0)
    kind = int if all(v == int(v) for v in scores.values()) else float
    scores = {k: kind(v if v > SENTINEL else least - 1) for k, v in scores.items()}
    return Vocabulary(scores, _single(min(scores.values()) - UNKNOWN_PENALTY), fallback)


class Counter:
    """Counts the pieces of texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.vocabulary = vocabulary
        self.kept = max(map(len, vocabulary.scores)) + 1
        self.known: dict[str, int] = {}

    def pieces(self, stretch: str) -> int:
        """Pieces of the best path over a stretch; a character without its own piece has an unknown one."""
        unknown, fallback, kept = self.vocabulary.unknown, self.vocabulary.bytes_fallback, self.kept
        floats = not self.vocabulary.exact
        sums, pieces, eras = [type(unknown)(0)] * kept, [0] * kept, [0] * kept
        bases: list[float] = []

        def rounded(total: float, era: int) -> float:
            """A sum as a 32-bit float, less the bases set after its begin."""
            total = _single(total)
            for base in bases[era:]:
                total = _single(total - base)
            return total

        matches = self.automaton.iter(stretch)
        last, piece = next(matches, (-1, None))
        for i, c in enumerate(stretch):
            best = count = None
            single = False
            while last == i:
                n, score = piece
                begin = (i + 1 - n) % kept
                now = sums[begin] + score
                if floats:
                    now = rounded(now, eras[begin])
                if best is None or now > best:
                    best, count = now, pieces[begin] + 1
                single = n == 1
                last, piece = next(matches, (-1, None))
            if not single:
                begin = i % kept
                now = sums[begin] + unknown
                if floats:
                    now = rounded(now, eras[begin])
                if best is None or now > best:
                    best, count = now, pieces[begin] + (len(c.encode("utf-8", "surrogatepass")) if fallback else 1)
            end = (i + 1) % kept
            if floats and best < REBASE:
                bases.append(best)
                best = 0.0
            sums[end], pieces[end], eras[end] = best, count, len(bases)
        return pieces[len(stretch) % kept]

    def count(self, text: str) -> int:
        total, known = 0, self.known
        text = SPACE + text.replace(" ", SPACE)
        if not self.vocabulary.exact:
            return self.pieces(text)
        for stretch in _STRETCH.findall(text):
            n = known.get(stretch)
            if n is None:
                if len(known) >= MEMORY:
                    known.clear()
                n = known[stretch] = self.pieces(stretch)
            total += n
        return total


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every row. The vocabulary file is read where the session runs and sent along, once."""
    vocabulary = tx.Sent(docs, load(path))

    def run(batches):
        counter = Counter(vocabulary.value)
        for batch in batches:
            column = batch.column("text")
            n = [counter.count(x) if x else 0 for x in (v.as_py() for v in column)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return tx.documents(docs).mapInArrow(run, "doc_id long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(tx.table(spark, sf_dir, "documents"))
