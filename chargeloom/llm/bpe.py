"""BPE encoding as a transducer with bounded lookahead, and decoding by an incremental state machine.

The merge list alone fixes how far to the right of a token boundary a text can still move it
(:meth:`Merges.lookahead`). Encoding therefore keeps a short run of symbols, and emits a token as soon as
that many symbols are known behind it: memory is constant however long a word or a text is. Decoding adds
one token's bytes at a time and emits the characters that are complete.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer as Library

from .common import BoundedCache, claim, texts_of, tune, unused_name

_CACHED = 400_000
_CACHED_WORDS = 150_000
_SHORT = 48
_PIECE = 1 << 20
#: A character of a block that Unicode still adds letters to.
UNSETTLED = re.compile("[^\x00-\u052f]").search
_TOKEN, _NONE = (1 << 20) - 1, 1 << 62


def byte_characters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next unused code from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in kept}
    out |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}
    return out


class Merges:
    """Merge rules by rank over token ids; each rule makes one token, and needs only earlier ones."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        # By left << 20 | right: rank << 20 | token.
        self.rules: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        later = {vocab[a + b] for a, b in merges}
        for rank, (a, b) in enumerate(merges):
            left, right, token = vocab[a], vocab[b], vocab[a + b]
            if left in later or right in later or token not in later:
                raise ValueError(f"rule {rank} ({a} {b}) is out of order; the lookahead bound does not hold")
            later.discard(token)
            self.rules[left << 20 | right] = rank << 20 | token
            self.halves[token] = (left, right)
            self.size[token] = self.size.get(left, 1) + self.size.get(right, 1)
        self.longest = max(self.size.values(), default=1)

    def lookahead(self) -> int:
        """Symbols to the right of a boundary that can decide whether a merge crosses it.

        A rule (a, b) crosses the boundary before b unless b does not come about or is taken first: by a
        rule of lower rank that crosses the right edge of b and uses b's end (a token on b's right spine).
        So a rule needs the length of b plus the most that any such earlier rule needs, which one pass in
        rank order computes.
        """
        most: dict[int, int] = {}
        bound = 0
        for rule in sorted(self.rules.values()):
            left, right = self.halves[rule & _TOKEN]
            behind, end = 0, right
            while True:
                behind = max(behind, most.get(end, 0))
                if end not in self.halves:
                    break
                end = self.halves[end][1]
            need = self.size.get(right, 1) + behind
            most[left] = max(most.get(left, 0), need)
            bound = max(bound, need)
        return bound

    def apply(self, symbols: list[int]) -> list[int]:
        """All merges of a run of symbols: lowest rank first, from the left among equals."""
        return self._short(list(symbols)) if len(symbols) <= _SHORT else self._long(symbols)

    def _short(self, out: list[int]) -> list[int]:
        get = self.rules.get
        found = [get(a << 20 | b, _NONE) for a, b in zip(out, out[1:])]
        while found:
            best = min(found)
            if best == _NONE:
                break
            at, token = found.index(best), best & _TOKEN
            out[at : at + 2] = [token]
            del found[at]
            if at:
                found[at - 1] = get(out[at - 1] << 20 | token, _NONE)
            if at < len(found):
                found[at] = get(token << 20 | out[at + 1], _NONE)
        return out

    def _long(self, symbols: list[int]) -> list[int]:
        """The same by a heap over a linked list, for long runs."""
        get, many = self.rules.get, len(symbols)
        token, after, before = list(symbols), list(range(1, many + 1)), list(range(-1, many - 1))
        heap = [(rule >> 20, i, rule & _TOKEN, a, b) for i, (a, b) in enumerate(zip(token, token[1:])) if (rule := get(a << 20 | b))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= many or token[j] != b:
                continue
            token[i], token[j] = new, -1
            after[i] = after[j]
            if after[j] < many:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else many
                if right < many and (rule := get(token[left] << 20 | token[right])):
                    heapq.heappush(heap, (rule >> 20, left, rule & _TOKEN, token[left], token[right]))
        return [t for t in token if t >= 0]


class Transducer:
    """Symbols in, tokens out, holding at most a constant number of symbols."""

    def __init__(self, merges: Merges, lookahead: int | None = None) -> None:
        self.merges = merges
        self.ahead = merges.lookahead() if lookahead is None else lookahead
        self.room = self.ahead + 8 * merges.longest
        self.held: list[int] = []

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        """Take symbols; yield the tokens that nothing to come can change."""
        for symbol in symbols:
            self.held.append(symbol)
            if len(self.held) >= self.room:
                yield from self._emit(len(self.held) - self.ahead)

    def finish(self) -> Iterator[int]:
        """The word ends: yield what is left."""
        yield from self._emit(len(self.held))

    def _emit(self, upto: int) -> Iterator[int]:
        at, size = 0, self.merges.size
        for token in self.merges.apply(self.held):
            end = at + size.get(token, 1)
            if end > upto:
                break
            at = end
            yield token
        del self.held[:at]


class Decoder:
    """Token ids in, text out. ``form`` "text" joins the tokens' bytes, emits complete characters and
    replaces malformed bytes; "surface" joins the tokens' written forms by a space, as a tokenizer file
    without a decoder has it."""

    def __init__(self, surfaces: list[str], pieces: list[bytes], form: str) -> None:
        self.surfaces, self.pieces, self.form = surfaces, pieces, form
        self.first = True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.form == "surface":
            out = ("" if self.first else " ") + " ".join(map(self.surfaces.__getitem__, ids))
            self.first = False
            return out
        return self.machine.decode(b"".join(map(self.pieces.__getitem__, ids)))

    def finish(self) -> str:
        return "" if self.form == "surface" else self.machine.decode(b"", True)


class Tokenizer:
    """A word-level BPE tokenizer file: NFC, lower case, white space dropped, words ended by a suffix.

    Which characters are letters is settled for the blocks up to U+052F. A stretch with others is normalised and
    cut into words by the tokenizers library itself, whose Unicode tables decide; its words are merged here too.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or model["byte_fallback"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a lower-casing word-level BPE file")
        vocab = dict(model["vocab"])
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges = Merges(vocab, [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")).findall
        characters = byte_characters()
        self.inner = [vocab[characters[b]] for b in range(256)]
        self.last = [vocab[characters[b] + self.suffix] for b in range(256)]
        names = vocab | self.special
        self.surfaces = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.surfaces[i] = name
        self.bytes_of = {c: b for b, c in characters.items()}
        self.pieces = [self._bytes(s) for s in self.surfaces]
        self.library = Library.from_file(path)
        self.ahead = self.merges.lookahead()
        self.cached, self.cached_words = BoundedCache(_CACHED), BoundedCache(_CACHED_WORDS)

    def _bytes(self, surface: str) -> bytes:
        end = bool(self.suffix) and surface.endswith(self.suffix) and surface not in self.special
        body = surface[: -len(self.suffix)] if end else surface
        raw = surface.encode() if surface in self.special else bytes(self.bytes_of[c] for c in body)
        return raw + b" " * end

    def _streamed(self, raw: bytes) -> array:
        """Tokens of a long word: its bytes become symbols as the transducer takes them."""
        stream, out = Transducer(self.merges, self.ahead), array("i")
        out.extend(stream.feed(map(self.inner.__getitem__, memoryview(raw)[:-1])))
        out.extend(stream.feed([self.last[raw[-1]]]))
        out.extend(stream.finish())
        return out

    def _word(self, word: str) -> list[int] | array:
        """Tokens of one word: at once where it is short, else streamed."""
        found = self.cached_words.get(word)
        if found is None:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > self.ahead + self.merges.longest:
                return self._streamed(raw)
            found = self.merges.apply([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])
            self.cached_words.room()
            self.cached_words[word] = found
        return found

    def _plain(self, text: str) -> array:
        """Tokens of a text without special tokens."""
        out = array("i")
        if not text.isascii():
            if UNSETTLED(text):
                cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                for word, _ in cut:
                    out.extend(self._word(bytes(map(self.bytes_of.__getitem__, word)).decode()))
                return out
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for word in self.words(text.lower()):
            out.extend(self._word(word))
        return out

    def _unit(self, unit: str) -> bytes:
        if self.split_special is None or "<" not in unit:
            ids = self._plain(unit)
        else:
            ids = array("i")
            for part in self.split_special.split(unit):
                ids.extend([self.special[part]] if part in self.special else self._plain(part))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Token ids of a text as 32-bit integers.

        White space separates words and is dropped, so the text is taken apart at spaces and line ends;
        what lies between is looked up, or encoded once.
        """
        out = []
        at, get = 0, self.cached.get
        while at < len(text):
            end = len(text)
            if end - at > _PIECE:
                end = text.rfind(" ", at, at + _PIECE) + 1 or text.find(" ", at + _PIECE) + 1 or end
            units = text[at:end].replace("\n", " ").split(" ")
            found = list(map(get, units))
            if None in found:
                for i, unit in enumerate(units):
                    if found[i] is None:
                        ids = self.cached.get(unit)
                        if ids is None:
                            ids = self._unit(unit)
                            if len(unit) <= 200:
                                self.cached.room()
                                self.cached[unit] = ids
                        found[i] = ids
            out.append(b"".join(found))
            at = end
        return b"".join(out)

    def decode(self, ids: list[int], form: str = "surface") -> str:
        machine = Decoder(self.surfaces, self.pieces, form)
        parts = [machine.feed(ids[i : i + _PIECE]) for i in range(0, len(ids), _PIECE)]
        return "".join([*parts, machine.finish()])


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def load(path: str) -> Tokenizer:
    """The tokenizer of a file, once for each worker."""
    claim("bpe", _tokenizer.cache_clear)
    return _tokenizer(path)


def _lists(found: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))


def encoder(path: str):
    """A function from a text column to its token ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for column in batches:
            yield _lists([tokenizer.encode(text) for text in texts_of(column)])

    return encode


def decoder(path: str, form: str = "surface"):
    """A function from a column of token ids to text."""

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for column in batches:
            yield pa.array([None if ids is None else tokenizer.decode(ids, form) for ids in map(_ids, column)], pa.string())

    return decode


def round_trip(path: str, form: str = "surface"):
    """A function from a text column to struct<ids, decoded>: both ways in one worker."""

    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]))
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = load(path)
        for column in batches:
            found = [tokenizer.encode(text) for text in texts_of(column)]
            decoded = [tokenizer.decode(np.frombuffer(ids, np.int32).tolist(), form) for ids in found]
            yield pa.StructArray.from_arrays([_lists(found), pa.array(decoded, pa.string())], names=["ids", "decoded"])

    return both


def _ids(row: pa.Scalar) -> list[int] | None:
    return row.values.to_numpy(zero_copy_only=False).tolist() if row.is_valid else None


def encode_documents(docs: DataFrame, path: str, *, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with ``<out_col>``: the token ids (array<int>) of the whole text.

    Special tokens written in a text become their ids; none is added. A null or empty text, and one of white
    space alone, has no ids (an empty array). A very long text is taken apart at spaces, a very long word streamed.
    Repeated rows are encoded alike, an empty table gives no rows, and an existing column ``<out_col>`` is
    replaced. ``path`` names the tokenizer file on every machine.
    """
    tune(docs.sparkSession)
    return docs.withColumn(out_col, encoder(path)(F.col(text_col)))


def decode_documents(docs: DataFrame, path: str, *, ids_col: str = "ids", out_col: str = "decoded", form: str = "surface") -> DataFrame:
    """``docs`` with ``<out_col>``: the text of the ids, in the form that :class:`Decoder` describes.

    No ids give the empty text; null ids give null; an id that is null or outside the vocabulary fails the job.
    Very long lists are decoded in slices. Repeated rows are decoded alike, an empty table gives no rows, and an
    existing column ``<out_col>`` is replaced.
    """
    tune(docs.sparkSession)
    return docs.withColumn(out_col, decoder(path, form)(F.col(ids_col)))


def round_trip_documents(docs: DataFrame, path: str, *, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded", form: str = "surface") -> DataFrame:
    """``docs`` with the columns of :func:`encode_documents` and :func:`decode_documents`, ids passing no second worker.

    The cases of both hold: a null text has no ids and decodes to the empty text. Existing columns of the two names
    are replaced, all others stay, whatever their names.
    """
    tune(docs.sparkSession)
    both = unused_name("coded", docs)
    coded = docs.withColumn(both, round_trip(path, form)(F.col(text_col)))
    return coded.withColumns({ids_col: F.col(both)["ids"], out_col: F.col(both)["decoded"]}).drop(both)
