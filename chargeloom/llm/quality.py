"""A quality score learned from trusted positives and unlabelled text.

The risk is the non-negative unbiased one: with class prior p, loss l, positives P and unlabelled U,
``p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)])``. When the second part turns negative on a batch
the network has begun to memorise the positives, and the step undoes that part instead. With the logistic
loss, ``sigmoid(f)`` estimates the probability that a text is a positive.

Features are shares and ratios of the whole text (characters by class, words, lines, repeats) and hashed shares
of its words and of its runs of three bytes, so a text costs one pass and a model is some ten kilobytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, hash_share, row_groups, tune, utf8_parts
from .decontaminate import LOWER, WORD_BYTES, hash_ranges, split_words

#: Bounds of the samples that the model is fitted on: smallest hashes of the document id.
MAX_POSITIVES = 10_000
MAX_UNLABELLED = 20_000

THRESHOLD = 0.7

_HIDDEN = 24
_EPOCHS = 60
_BATCH = 512
_RATE = 0.01
_DECAY = 1e-4

_SPACE, _MARKS = [9, 10, 11, 12, 13, 32], [ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]
_SHARES, _BITS = 24, 6
_FEATURES = _SHARES + 2 * (1 << _BITS)
_SLICE, _LONG = 1 << 20, 1 << 16
_WHITE, _SENTENCE = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[_SPACE], _SENTENCE[list(b".!?")] = True, True
#: Hashed shares are many and noisy: each is scaled down by so much beside the others.
_SOFTER = 3.0


def _hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; long ones are hashed by themselves, so that none needs several times its size."""
    out = np.empty(len(start), np.uint64)
    long = end - start > _LONG
    out[~long] = hash_ranges(raw, start[~long], end[~long])
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh64_intdigest(memoryview(raw)[start[i] : end[i]])
    return out


def _cuts(inside: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive slices of about ``most`` bytes that cut no run of ``inside``."""
    first, size = 0, len(inside)
    while first < size:
        last = first + most
        while last < size and inside[last - 1] and inside[last]:
            gap = np.flatnonzero(~inside[last : last + most])
            last = last + int(gap[0]) if len(gap) else last + most
        yield first, min(last, size)
        first = last


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true begin and end."""
    steps = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return steps[::2], steps[1::2]


def features(raw: np.ndarray | bytes) -> list[float]:
    """Length-free shares of the bytes of a UTF-8 text, plus its log lengths; zeros for a text without words.

    Words, pairs of words and lines are compared by 64-bit hashes, made slice by slice: a text costs some three
    times its size, whatever its words are.
    """
    out = [0.0] * _SHARES
    raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    inside = ~_WHITE[raw]
    hashes, many, squares, short, tall = [], 0, 0, 0, 0
    seen = np.zeros(256, np.int64)
    for first, last in _cuts(inside, _SLICE):
        seen += np.bincount(raw[first:last], minlength=256)
        start, end = _edges(inside[first:last])
        lengths = end - start
        hashes.append(_hashes(raw[first:last], start, end))
        many += len(lengths)
        squares += int((lengths**2).sum())
        short += int((lengths <= 2).sum())
        tall += int((lengths >= 15).sum())
    if not many:
        return out
    h = np.concatenate(hashes)
    del hashes
    size = len(raw)
    lower, upper, other = int(seen[97:123].sum()), int(seen[65:91].sum()), int(seen[128:].sum())
    letters = max(1, lower + upper + other)
    spaces = int(seen[_SPACE].sum())
    black = max(1, size - spaces)
    again = int((h[1:] == h[:-1]).sum())
    pairs = _distinct(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(31))))
    distinct = _distinct(h)
    # Lines end at a newline; those without a word do not count.
    end = np.append(np.flatnonzero(raw == 10), size)
    start = np.append(0, end[:-1] + 1)
    filled = np.logical_or.reduceat(np.append(inside, False), start) & (end > start)
    start, end = start[filled], end[filled]
    lines, ends = len(start), raw[end - 1]
    mean = int(inside.sum()) / many
    out[0] = np.log1p(many)
    out[1] = np.log1p(size / many)
    out[2] = upper / letters
    out[3] = other / letters
    out[4] = int(seen[48:58].sum()) / black
    out[5] = int(seen[_MARKS].sum()) / black
    out[6] = int(seen[ord("!")]) / many
    out[7] = int(seen[ord("|")]) / many
    out[8] = int(seen[ord(".")]) / many
    out[9] = int(seen[ord(",")]) / many
    out[10] = int(seen[ord("?")]) / many
    out[11] = (int(seen[33:48].sum()) + int(seen[58:65].sum()) + int(seen[91:97].sum()) + int(seen[123:127].sum())) / black
    out[12] = distinct / many
    out[13] = (distinct / many) * np.log1p(many)
    out[14] = again / many
    out[15] = pairs / max(1, many - 1)
    out[16] = _distinct(_hashes(raw, start, end)) / max(1, lines)
    out[17] = np.log1p(lines) - np.log1p(many)
    out[18] = float(np.sqrt(max(0.0, squares / many - mean**2))) / 10
    out[19] = short / many
    out[20] = tall / many
    out[21] = int(_SENTENCE[ends].sum()) / max(1, lines)
    out[22] = (int(seen[:9].sum()) + int(seen[14:32].sum()) + int(seen[127])) / size
    out[23] = spaces / size
    return out


def _distinct(hashes: np.ndarray) -> int:
    """How many values differ; the array is sorted in place."""
    hashes.sort()
    return int((hashes[1:] != hashes[:-1]).sum()) + (len(hashes) > 0)


def hashed_counts(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row how many of its hashes have each value of their highest bits."""
    cells = (row << _BITS) + (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
    return np.bincount(cells, minlength=rows << _BITS).reshape(rows, -1).astype(np.float64)


def _counts(raw: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Hashed counts of the words and of the runs of three bytes of each row."""
    rows = len(marks) - 1
    words = split_words(raw, marks)
    text = raw[marks[0] : marks[-1]].astype(np.uint64)
    runs = np.zeros((rows, 1 << _BITS))
    if len(text) > 2:
        grams = (text[:-2] | text[1:-1] << np.uint64(8) | text[2:] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
        of = np.repeat(np.arange(rows), np.diff(marks))
        whole = of[:-2] == of[2:]
        runs = hashed_counts(grams[whole], of[:-2][whole], rows)
    return np.concatenate([hashed_counts(words.hashes, words.row, rows), runs], axis=1)


def _long_counts(raw: np.ndarray) -> np.ndarray:
    """:func:`_counts` of one long text, slice by slice: slices cut no word, and runs of bytes over a cut are added."""
    total = np.zeros((1, 2 << _BITS))
    for first, last in _cuts(WORD_BYTES[LOWER[raw]], _SLICE):
        total += _counts(raw, np.array([first, last], np.int64))
        if last < len(raw):
            over = raw[max(0, last - 2) : last + 2]
            bridge = _counts(over, np.array([0, len(over)], np.int64))[:, 1 << _BITS :]
            # Runs that lie on one side of the cut are counted with their slice.
            total[:, 1 << _BITS :] += bridge
    return total


def feature_rows(column: pa.Array) -> np.ndarray:
    """Features of each text of a column; nulls count as empty."""
    raw, marks = utf8_parts(column)
    out = np.zeros((len(marks) - 1, _FEATURES))
    for i, (a, b) in enumerate(zip(marks[:-1].tolist(), marks[1:].tolist())):
        out[i, :_SHARES] = features(raw[a:b])
    for first, last in row_groups(marks, _SLICE):
        own = marks[first : last + 1]
        found = _counts(raw, own) if last - first > 1 or own[-1] - own[0] <= 2 * _SLICE else _long_counts(raw[own[0] : own[-1]])
        for part in (slice(0, 1 << _BITS), slice(1 << _BITS, None)):
            counts = found[:, part]
            found[:, part] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
        out[first:last, _SHARES:] = found
    return out


@dataclass
class Model:
    """Standardisation and a network with one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ w + b) @ v + c[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk(weights: list[np.ndarray], positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float, list[np.ndarray]]:
    """The two parts of the risk on a batch, and the gradient of what a step lowers.

    The parts are ``prior * E_P[l(f)]`` and ``E_U[l(-f)] - prior * E_P[l(-f)]`` with the logistic loss. A step lowers
    their sum; where the second part is negative, it raises that part instead.
    """
    w, b, v, c = weights
    x = np.concatenate([positives, unlabelled])
    hidden = np.tanh(x @ w + b)
    f = hidden @ v + c[0]
    fp, fu = f[: len(positives)], f[len(positives) :]
    positive = prior * np.logaddexp(0, -fp).mean()
    negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    # l(f) = log(1 + exp(-f)); its slope is -sigmoid(-f).
    slope = np.concatenate([-prior * _sigmoid(fp) / len(fp), _sigmoid(fu) / len(fu)])
    if negative >= 0:
        slope[: len(fp)] -= prior * _sigmoid(-fp) / len(fp)
    else:
        slope = -slope
    back = slope[:, None] * v[None, :] * (1 - hidden**2)
    return positive, negative, [x.T @ back, back.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])]


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 42) -> Model:
    """Minimise the non-negative risk by Adam over batches of both samples."""
    # Mean and deviation of both samples together, without a copy of them.
    many = len(positives) + len(unlabelled)
    mean = (positives.sum(axis=0, dtype=np.float64) + unlabelled.sum(axis=0, dtype=np.float64)) / many
    scale = np.sqrt(sum((((x - mean.astype(x.dtype)) ** 2).sum(axis=0, dtype=np.float64) for x in (positives, unlabelled))) / many)
    scale[scale < 1e-6] = 1
    scale[_SHARES:] *= _SOFTER
    rng = np.random.default_rng(seed)
    weights = [rng.normal(0, 1 / np.sqrt(_FEATURES), (_FEATURES, _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, 1 / np.sqrt(_HIDDEN), _HIDDEN), np.zeros(1)]
    model = Model(mean, scale, weights, prior)
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    zp, zu = (np.clip((x - mean.astype(x.dtype)) / scale.astype(x.dtype), -8, 8) for x in (positives, unlabelled))
    step = 0
    batches = max(1, -(-len(zu) // _BATCH))
    for epoch in range(_EPOCHS):
        order_u, order_p = rng.permutation(len(zu)), rng.permutation(len(zp))
        rate = _RATE * (1 - epoch / _EPOCHS)
        for k in range(batches):
            xp = zp[order_p[k::batches]] if len(zp) >= batches else zp
            _, _, grads = risk(weights, xp, zu[order_u[k::batches]], prior)
            step += 1
            for i, g in enumerate(grads):
                g = g + _DECAY * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g**2
                weights[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, seed: int = 42) -> float:
    """The class prior from positives and unlabelled rows alone.

    Half of each sample fits a classifier of positives against unlabelled; on the other half, the share of
    unlabelled rows above a score over the share of positives above it bounds the prior, and the least
    bound (with a confidence margin) is taken.
    """
    rng = np.random.default_rng(seed)
    p, u = positives[rng.permutation(len(positives))], unlabelled[rng.permutation(len(unlabelled))]
    hp, hu = len(p) // 2, len(u) // 2
    if hp < 10 or hu < 10:
        return 0.5
    model = fit(p[:hp], u[:hu], 0.5, seed)
    sp, su = np.sort(model.margin(p[hp:])), np.sort(model.margin(u[hu:]))
    at = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    share_p = 1 - np.searchsorted(sp, at, side="left") / len(sp)
    share_u = 1 - np.searchsorted(su, at, side="left") / len(su)
    slack = np.sqrt(np.log(40) / 2 * (1 / len(su) + 1 / len(sp)))
    best = int(np.argmin((share_u + slack) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    prior: float | None = None,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
) -> Model:
    """Fit on rows outside the held-out fold: positives are labels of 1, unlabelled any documents.

    The prior is :func:`estimate_prior`'s unless it is given. Samples are the distinct ids with the smallest hashes,
    so they do not depend on partitioning, with one row for each id (by a hash of its text); their bounds are the
    ``max_*`` parameters, and only their features reach the driver. A document with several labels counts with the
    smallest; null ids and null labels are left out. Without any positive or any document the model scores every
    text alike, at the prior.
    """
    tune(docs.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("id")) != 2)).groupBy("id").agg(F.min("label").alias("label"))
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull() & (fold(F.col("id")) != 2))
    positives = _smallest(marked.filter("label = 1").select("id"), max_positives, 0).select("id", F.lit(1).alias("part"))
    unlabelled = _smallest(ids, max_unlabelled, 1).select("id", F.lit(2).alias("part"))
    chosen = positives.union(unlabelled).groupBy("id").agg(F.sum("part").alias("part"))
    # At most max_positives + max_unlabelled ids: a proven bound for the broadcast.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", "part", F.xxhash64("text").alias("hash"), "text")
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("part", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("x", T.BinaryType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = feature_rows(batch.column(3)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([row.tobytes() for row in x], pa.binary())], names=schema.names)

    # One row an id, chosen while rows are gathered: an id that many rows share sends one.
    rows = sample.mapInArrow(emit, schema).groupBy("id").agg(F.max("part").alias("part"), F.min_by("x", F.struct("hash", "x")).alias("x")).toPandas()
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, _FEATURES)
    # The same order whatever the partitions, so that the same model is learned.
    order = np.argsort(rows["id"].astype(str).to_numpy(), kind="stable")
    part = rows["part"].to_numpy(np.int64)[order]
    del rows
    p, u = x[order[part % 2 == 1]], x[order[part >= 2]]
    if not len(p) or not len(u):
        flat = 0.5 if prior is None else prior
        level = float(np.log(np.clip(flat, 1e-6, 1 - 1e-6) / np.clip(1 - flat, 1e-6, 1)))
        return Model(np.zeros(_FEATURES), np.ones(_FEATURES), [np.zeros((_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array([level])], flat)
    return fit(p, u, estimate_prior(p, u) if prior is None else prior)


def _smallest(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` distinct ids: those with the smallest hashes, thinned by hash before they are ranked."""
    known = ids.agg(F.approx_count_distinct("id")).first()[0]
    share = min(1.0, (4 * most + 1000) / max(1, known))
    hashed = hash_share("id", F.lit(seed))
    return ids.filter(hashed <= share).distinct().orderBy(hashed, "id").limit(most)


def scorer(model: Model):
    """A function from a text column to the score, 0 to 1; null counts as the empty text."""

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(feature_rows(column)))

    return score


def held_out(id_col: Column) -> Column:
    """Whether an id is in the part that no label was learned from; false for null."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where the score reaches the threshold).

    Every row is scored on its whole text, however long, by the text alone. Null and empty texts get the score of a
    text without words; repeated rows are scored alike; an empty table gives no rows. Columns of ``docs`` named
    ``score`` or ``predicted`` are replaced, others stay.
    """
    score = scorer(train(docs, labels, id_col=id_col, text_col=text_col, **options))
    return docs.withColumn("score", score(F.col(text_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
