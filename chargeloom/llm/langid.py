"""Language identification with labelled spans.

The script of a word narrows its candidate languages; each candidate is scored by character n-grams; a
Viterbi pass over the words of a text, with a penalty for every switch, labels spans of mixed text.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BoundedCache, claim, fold, hash_share, row_groups, texts_of, tune

#: Documents for each language that the model is fitted on: smallest hashes of the document id.
MAX_TRAIN_DOCS = 2_000
#: Documents of all languages together: beyond 100 languages each has fewer than MAX_TRAIN_DOCS, and one at least.
MAX_SAMPLE = 200_000
#: Up to so many languages have their sizes broadcast; beyond, the join shuffles.
MAX_LANGUAGES = 10_000

PENALTY = 6.0
UNDETERMINED = "und"

_ORDERS = (1, 2, 3)
_SMOOTH = 0.5
_FLOOR = -6.0
_CACHED = 300_000
#: Word scores that a worker keeps take at most so many bytes.
_CACHED_BYTES = 64 << 20


_WORD = re.compile(r"[^\W\d_]+")
# What that takes beside letters: characters that stand for numbers, like fractions and circled digits.
_NUMBERS = {c: " " for c in map(chr, range(0x80, 0x110000)) if c.isnumeric() and not c.isalpha()}
_BLANKED = str.maketrans(_NUMBERS)
#: Words that are scored at a time, which bounds the memory of their n-grams.
_AT_ONCE = 4096
#: Characters of texts whose words are held at a time; a longer text stands alone.
_CHARS = 1 << 20

# First code point and script of each block that letters are told apart by.
SCRIPTS = [
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0780, "Other"),
    (0x0900, "Devanagari"),
    (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"),
    (0x0B00, "Other"),
    (0x0B80, "Tamil"),
    (0x0C00, "Telugu"),
    (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"),
    (0x0E00, "Thai"),
    (0x0E80, "Lao"),
    (0x0F00, "Other"),
    (0x1000, "Myanmar"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Ethiopic"),
    (0x13A0, "Other"),
    (0x1780, "Khmer"),
    (0x1800, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x2C60, "Latin"),
    (0x2C80, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Other"),
    (0x3400, "Han"),
    (0xA000, "Other"),
    (0xA720, "Latin"),
    (0xA800, "Other"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0x20000, "Han"),
]
_STARTS = [a for a, _ in SCRIPTS]


def script(char: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(char)) - 1][1]


def grams(word: str) -> list[str]:
    """Character n-grams of a lower-cased word between boundary marks."""
    marked = f"^{word}$"
    return [marked[i : i + n] for n in _ORDERS for i in range(len(marked) - n + 1)]


def gram_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the words between boundary marks, as integers of 21 bits a character, and the word of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(f"^{'$^'.join(words)}$".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    keys, owners, running = [], [], np.zeros(len(codes), np.int64)
    for n in range(1, max(_ORDERS) + 1):
        running = (running[: len(codes) - n + 1] << 21) | codes[n - 1 :]
        if n in _ORDERS:
            whole = owner[: len(running)] == owner[n - 1 :]
            keys.append(running[whole])
            owners.append(owner[: len(running)][whole])
    return np.concatenate(keys), np.concatenate(owners)


@dataclass
class Model:
    """Log-probabilities of n-grams in languages, and the scripts that a language is written in.

    The table is sparse: gram ``i`` (by sorted key) has the entries ``first[i]`` to ``first[i + 1]`` of ``language``
    and ``gain``, each the log-probability over that of a gram that the language has not shown.
    """

    languages: list[str]
    keys: np.ndarray
    first: np.ndarray
    language: np.ndarray
    gain: np.ndarray
    unseen: np.ndarray
    scripts: dict[str, np.ndarray]
    #: Names the model's word scores in a worker, which outlive the task that this object belongs to.
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def posteriors(self, words: list[str]) -> np.ndarray:
        """Log posterior of each language for each word, floored; languages outside the script's candidates get the floor."""
        if len(words) > _AT_ONCE:
            return np.concatenate([self.posteriors(words[i : i + _AT_ONCE]) for i in range(0, len(words), _AT_ONCE)])
        keys, owner = gram_keys(words)
        many, langs = len(words), len(self.languages)
        total = np.bincount(owner, minlength=many)[:, None] * self.unseen[None, :]
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[spot] == keys
            spot, owner = spot[known], owner[known]
            sizes = self.first[spot + 1] - self.first[spot]
            entry = np.repeat(self.first[spot] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            cell = np.repeat(owner, sizes) * langs + self.language[entry]
            total = total + np.bincount(cell, weights=self.gain[entry], minlength=many * langs).reshape(many, langs)
        for i, word in enumerate(words):
            allowed = self.scripts.get(script(word[0]))
            if allowed is not None and not allowed.all():
                total[i, ~allowed] = -np.inf
        total -= total.max(axis=1, keepdims=True)
        return np.maximum(total - np.log(np.exp(total).sum(axis=1, keepdims=True)), _FLOOR)

    def scores(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """For each list of words a row of log posteriors for each word; distinct words are scored once and kept."""
        claim("langid", _kept.clear)
        if self.key not in _kept:
            _kept.clear()
            _kept[self.key] = WordScores(len(self.languages))
        kept = _kept[self.key]
        new = set().union(*texts).difference(kept.index)
        if len(kept.index) + len(new) > kept.index.limit:
            kept.index.clear()
            new = set().union(*texts)
        if len(new) > kept.index.limit:
            yield from map(self.posteriors, texts)
            return
        if new:
            kept.add(list(new), self.posteriors(list(new)))
        for words in texts:
            yield kept.table[np.fromiter(map(kept.index.__getitem__, words), np.int64, len(words))].astype(np.float64)


class WordScores:
    """Scores of words in rows that grow with the words, up to a bound in bytes."""

    def __init__(self, languages: int) -> None:
        self.index = BoundedCache(max(1, min(_CACHED, _CACHED_BYTES // (4 * max(1, languages)))))
        self.table = np.zeros((min(1024, self.index.limit), languages), np.float32)

    def add(self, words: list[str], scores: np.ndarray) -> None:
        first, last = len(self.index), len(self.index) + len(words)
        if last > len(self.table):
            grown = np.zeros((min(self.index.limit, max(last, 2 * len(self.table))), self.table.shape[1]), np.float32)
            grown[:first] = self.table[:first]
            self.table = grown
        self.table[first:last] = scores
        self.index.update(zip(words, range(first, last)))


_kept: dict[str, WordScores] = {}


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The path of states that maximises the sum of scores less ``penalty`` for each switch.

    Ties stay with the smaller state, and with no switch. A stretch away from the best constant path costs two
    switches, or one at either end of the text; where no stretch gains as much, that path is the answer and
    no backward pass is needed.
    """
    steps, states = scores.shape
    best = int(np.argmax(scores.sum(axis=0)))
    if states == 1:
        return np.full(steps, best)
    rest = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
    sums = np.concatenate([[0.0], np.cumsum(rest)])
    ends = max(sums[1:].max(), sums[-1] - sums[:-1].min())
    if ends <= penalty and (sums[1:] - np.minimum.accumulate(sums)[:-1]).max() <= 2 * penalty:
        return np.full(steps, best)
    rows = scores.tolist()
    now, back = rows[0], []
    for row in rows[1:]:
        most = max(now)
        top, switched = now.index(most), most - penalty
        back.append([j if x >= switched else top for j, x in enumerate(now)])
        now = [(x if x >= switched else switched) + y for x, y in zip(now, row)]
    path = [now.index(max(now))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1], np.int64)


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters of a text."""
    if not text.isascii() and not _NUMBERS.keys().isdisjoint(text):
        text = text.translate(_BLANKED)
    return _WORD.findall(text.lower())


def label(model: Model, words: list[str], scores: np.ndarray, penalty: float = PENALTY) -> tuple[str, float, list[tuple[int, int, str]]]:
    """The language of a text, its score, and ``(first word, end word, language)`` spans."""
    if not words or not model.languages:
        return UNDETERMINED, 0.0, []
    path = viterbi(scores, penalty)
    letters = np.fromiter(map(len, words), np.float64, len(words))
    by = np.bincount(path, weights=letters, minlength=len(model.languages))
    best = int(np.argmax(by))
    own = path == best
    sure = float((np.exp(scores[own, best]) * letters[own]).sum() / letters[own].sum())
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    return model.languages[best], float(np.clip(by[best] / letters.sum() * sure, 0, 1)), [(a, b, model.languages[path[a]]) for a, b in zip(cuts, cuts[1:])]


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fit on at most ``max_docs`` documents for each language outside the held-out fold, ``MAX_SAMPLE`` in all.

    The sample is chosen from distinct ids and languages alone (a column-pruned scan, ranked before it is
    shuffled); of rows that share id and language one is taken. Its n-grams are counted by Spark, and all that it
    holds reach the driver: their number is bounded by the sample's. Rows with a null id, a null language or no
    letter teach nothing; without any row every text is ``und``.
    """
    tune(docs.sparkSession)
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("id")) != 2))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"))
    many = sizes.count()
    each = max(1, min(max_docs, MAX_SAMPLE // max(1, many)))
    # Both tables are sent to all tasks only where their rows are counted: a row a language, and at most MAX_SAMPLE ids.
    sent = F.broadcast if many <= MAX_LANGUAGES else (lambda rows: rows)
    # Thinned by hash to about four times the bound first, so that ranking does not grow with the input.
    thinned = known.withColumn("hash", hash_share("id")).join(sent(sizes), "lang").filter(F.col("hash") <= (4 * each + 1000) / F.col("ids"))
    ids = thinned.select("id", "lang", "hash").distinct().selectExpr("id", "lang", "row_number() over (partition by lang order by hash, id) as place").filter(F.col("place") <= each)
    chosen = sent(ids.select("id", "lang"))
    sample = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).join(chosen, ["id", "lang"])
    sample = sample.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, seen in words.items():
                found: Counter = Counter()
                for word, n in seen.items():
                    for g in grams(word):
                        found[g] += n
                    found["#" + script(word[0])] += n * len(word)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(found), "gram": list(found), "n": list(found.values())}, schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]))

    kept = sample.select("lang", "text").mapInArrow(emit, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    kept = kept.sort_values(["gram", "lang"], kind="stable")
    languages = sorted(kept["lang"].unique().tolist())
    is_script = kept["gram"].str.startswith("#") & (kept["gram"].str.len() > 3)
    scripts: dict[str, np.ndarray] = {}
    by_script = kept[is_script]
    totals = by_script.groupby("lang")["n"].sum()
    for name, part in by_script.groupby("gram"):
        share = {r.lang: r.n / totals[r.lang] for r in part.itertuples()}
        allowed = np.array([share.get(x, 0) >= 0.01 for x in languages])
        if allowed.any():
            scripts[name[1:]] = allowed
    found = kept[~is_script]
    names = found["gram"].unique().tolist()
    keys = np.array([sum(ord(c) << 21 * k for k, c in enumerate(reversed(g))) for g in names], dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    row = place[found["gram"].map({g: i for i, g in enumerate(names)}).to_numpy(np.int64)]
    column = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64)
    n, orders = found["n"].to_numpy(float), found["gram"].str.len().to_numpy(np.int64) - 1
    # Add-half smoothing over the n-grams of each order that any language shows, and one more.
    whole = np.zeros((len(_ORDERS), len(languages)))
    np.add.at(whole, (orders, column), n)
    kinds = np.array([sum(len(g) == k for g in names) + 1 for k in _ORDERS])
    base = np.log(whole + _SMOOTH * kinds[:, None])
    unseen = (np.log(_SMOOTH) - base).mean(axis=0) if languages else np.zeros(0)
    gain = np.log(n + _SMOOTH) - base[orders, column] - unseen[column]
    by_row = np.lexsort((column, row))
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(names)))]).astype(np.int64)
    return Model(languages, keys[order], first, column[by_row], gain[by_row], unseen, scripts)


_RESULT = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))),
    ]
)
_ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])


def labeller(model: Model, penalty: float = PENALTY):
    """A function from a text column to struct<lang, score, spans>."""

    @F.arrow_udf(_RESULT)
    def identify(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            texts, found = texts_of(column), []
            for a, b in row_groups(np.cumsum([0, *map(len, texts)]), _CHARS):
                words = list(map(words_of, texts[a:b]))
                found += [label(model, w, s, penalty) for w, s in zip(words, model.scores(words))]
            yield pa.array([{"lang": x, "score": s, "spans": [{"start": a, "end": b, "lang": y} for a, b, y in spans]} for x, s, spans in found], _ARROW)

    return identify


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", penalty: float = PENALTY, out_col: str = "language", **options) -> DataFrame:
    """``docs`` with ``<out_col>``: struct of ``lang``, ``score`` (0 to 1) and the labelled ``spans`` of words.

    The language is the one whose spans hold most letters (ties: the first in alphabetical order); the score
    is their share of all letters times the mean posterior of their words. A null text, or one without a
    letter, is ``und`` with score 0 and no spans; characters that stand for numbers are no letters. Every row is
    labelled by its whole text alone, however long; repeated rows alike; an empty table gives no rows; an existing
    column ``<out_col>`` is replaced, others stay.
    """
    identify = labeller(train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options), penalty)
    return docs.withColumn(out_col, identify(F.col(text_col)))


def held_out(id_col: Column) -> Column:
    """Whether an id is in the part that nothing was learned from; false for null."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))
