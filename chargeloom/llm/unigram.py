"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic programming
keeps, for each position, only the best score and the number of pieces on its path. No text is segmented.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import BoundedCache, claim, texts_of, tune

SPACE = "▁"
UNKNOWN_PENALTY = 10.0

_CACHED = 300_000
_SIXTEENTHS = 16


def as_unigram(path: str) -> bytes:
    """A sentencepiece file as a unigram model, serialised.

    A unigram file is taken as it is. The scores of a BPE file are no log-probabilities but places in the list of
    merges, with -10^9 for pieces that no merge makes; its pieces get the log-probabilities that Zipf's law gives
    their place, to the nearest sixteenth.
    """
    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.trainer_spec.model_type != model.trainer_spec.UNIGRAM:
        model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
        ranked = sorted((p for p in model.pieces if p.type == p.NORMAL), key=lambda p: -p.score)
        for place, piece in enumerate(ranked):
            piece.score = -round(_SIXTEENTHS * math.log(place + 2)) / _SIXTEENTHS
    return model.SerializeToString()


def _plain(serialised: bytes) -> bool:
    """Whether a model leaves texts as they are but for the space in front; an error if its rules are not those of this module."""
    model = proto.ModelProto()
    model.ParseFromString(serialised)
    if any(p.type == p.USER_DEFINED for p in model.pieces):
        raise ValueError("pieces defined by a user are matched before all others, which is not done here")
    if model.trainer_spec.treat_whitespace_as_suffix or not model.normalizer_spec.escape_whitespaces:
        raise ValueError("spaces that do not begin pieces are not supported")
    spec = model.normalizer_spec
    return spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap


class Counter:
    """Best score and piece count of texts under the pieces and scores of :func:`as_unigram`.

    The rules are those of the library's unigram model: texts go through the file's normalizer (by the library, if it does
    more than that) and get a space in front, and spaces become ``SPACE``;
    among equal scores at a position the path whose last piece begins first is kept; a character that is not a
    piece itself may stand as unknown at the lowest score less ``UNKNOWN_PENALTY``, and counts its bytes where the
    file has byte pieces, else one. Sums of sixteenths are exact, in the library too, however long the text.

    No piece has ``SPACE`` behind another character, so every path ends a piece where a run of spaces begins: what
    lies between two such places adds the same wherever it stands, so it is scored once and kept.
    """

    def __init__(self, path: str) -> None:
        serialised = as_unigram(path)
        model = sentencepiece.SentencePieceProcessor(model_proto=serialised)
        self.normalizer = None if _plain(serialised) else model
        pieces = {}
        self.bytes = False
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                self.bytes = True
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = float(model.get_score(i))
        self.build(pieces)

    def build(self, pieces: dict[str, float]) -> None:
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece spans a space; stretches cannot be scored by themselves")
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.lines = not any("\n" in p for p in pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.index = BoundedCache(_CACHED)
        self.scores, self.counts = np.zeros(_CACHED), np.zeros(_CACHED, np.int64)

    def _unknown_size(self, char: str) -> int:
        return len(char.encode("utf-8", "surrogatepass")) if self.bytes else 1

    def stretch(self, text: str) -> tuple[float, int]:
        """Score and count of one stretch."""
        low = float("-inf")
        best, count = [0.0] + [low] * len(text), [0] * (len(text) + 1)
        alone = [False] * len(text)
        # Matches come by end, and for one end the longest first: the earliest start wins a tie.
        at = 0
        for end, (size, score) in self.automaton.iter(text):
            while at < end:
                if not alone[at]:
                    self._fill(text, at, best, count)
                at += 1
            start = end + 1 - size
            if size == 1:
                alone[end] = True
            if best[start] + score > best[end + 1]:
                best[end + 1], count[end + 1] = best[start] + score, count[start] + 1
        while at < len(text):
            if not alone[at]:
                self._fill(text, at, best, count)
            at += 1
        return best[-1], count[-1]

    def _fill(self, text: str, at: int, best: list[float], count: list[int]) -> None:
        """The character at ``at`` as unknown, after all pieces that end there."""
        if best[at] + self.unknown > best[at + 1]:
            best[at + 1], count[at + 1] = best[at] + self.unknown, count[at] + self._unknown_size(text[at])

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text; line ends stand alone where no piece has one. A written ``SPACE`` is a space."""
        front = SPACE
        if self.normalizer is not None:
            text = self.normalizer.normalize(text)
            front = SPACE if text.startswith(SPACE) else ""
            text = text[len(front) :]
            if not (front or text):
                return []
        text = text.replace(SPACE, " ")
        out: list[str] = []
        for n, line in enumerate(text.split("\n") if self.lines else [text]):
            if n:
                out.append("\n")
            units = line.split(" ")
            if n == 0:
                units[0] = front + units[0]
            units[1:] = [SPACE + u for u in units[1:]]
            if SPACE in units:
                held = ""
                for u in units:
                    if u == SPACE:
                        held += u
                    else:
                        out.append(held + u)
                        held = ""
                if held:
                    out.append(held)
            else:
                out += units
        return [u for u in out if u]

    def count(self, texts: list[str]) -> list[tuple[int, float]]:
        """(tokens, score) of each text; an empty text has none."""
        parts = [self.stretches(t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.index)
        if len(self.index) + len(new) > self.index.limit:
            self.index.clear()
            new = set().union(*parts)
        if len(new) > self.index.limit:
            return [(sum(n for _, n in found), math.fsum(s for s, _ in found)) for found in ([self.stretch(u) for u in p] for p in parts)]
        for unit in new:
            at = len(self.index)
            self.scores[at], self.counts[at] = self.stretch(unit)
            self.index[unit] = at
        get = self.index.__getitem__
        out = []
        for p in parts:
            at = np.fromiter(map(get, p), np.int64, len(p))
            out.append((int(self.counts[at].sum()), float(self.scores[at].sum())))
        return out


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


def load(path: str) -> Counter:
    """The counter of a file, once for each worker."""
    claim("unigram", _counter.cache_clear)
    return _counter(path)


_RESULT = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])


def counter(path: str):
    """A function from a text column to struct<n_tokens, score>."""

    @F.arrow_udf(_RESULT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = load(path).count(texts_of(column))
            yield pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["n_tokens", "score"])

    return count


def count_tokens(docs: DataFrame, path: str, *, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """``docs`` with ``<out_col>``: struct of ``n_tokens`` and ``score`` (of the best path) of the whole text.

    A null or empty text has no tokens and score 0; white space counts like any other text; a very long text is
    scored like a short one; repeated rows are counted alike; an empty table gives no rows; a column ``<out_col>``
    is replaced, others stay.
    """
    tune(docs.sparkSession)
    return docs.withColumn(out_col, counter(path)(F.col(text_col)))
