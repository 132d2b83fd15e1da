"""Benchmark decontamination by winnowed k-gram fingerprints.

A benchmark window is ``WINDOW`` consecutive words of an item. Its k-grams form one winnowing window, of which the
smallest hash (the last of equal ones) is kept, once for all windows that share it: every span of ``WINDOW`` words
that a document and an item share has a fingerprint in common, at the same place in it. Fingerprints of documents
that the benchmark has are extended to the windows around them, and these are joined with the benchmark's on
fingerprint, window hash and the words themselves, so hits are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, row_groups, tune, utf8_parts

WINDOW = 10
K = 5

#: The benchmark's fingerprints and windows are sent to the workers as bitmaps of about so many bits for each, and of
#: at most 2^MAX_FILTER_BITS (16 MB).
FILTER_BITS_EACH = 32
MAX_FILTER_BITS = 27
#: Up to so many bytes of benchmark windows are broadcast to the join; beyond, it shuffles.
MAX_BROADCAST = 48 << 20
#: The benchmark's windows are kept in one file for so many bytes of its texts, not in one for each shuffle partition:
#: where Hadoop's native library is missing, an executor starts programs to set the mode of each file that it writes.
PART_BYTES = 1 << 18

_SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[ord("0") : ord("9") + 1] = True
WORD_BYTES[ord("a") : ord("z") + 1] = True
WORD_BYTES[0x80:] = True


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, _SLICE + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.multiply.accumulate(steps)
    return have[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of consecutive rows: byte ranges into ``raw`` (lower-cased), hashes, and the row of each."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    row: np.ndarray

    def text(self, first: int, n: int) -> str:
        raw = self.raw
        return b" ".join(raw[a:b].tobytes() for a, b in zip(self.start[first : first + n], self.end[first : first + n])).decode("utf-8", "replace")


def hash_ranges(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums over slices of bounded size."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        upto = max(at + 1, int(np.searchsorted(end, low + _SLICE, side="right")))
        high = int(end[upto - 1])
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", high - low), out=sums[1:])
        s, e = start[at:upto] - low, end[at:upto] - low
        out[at:upto] = (sums[e] - sums[s]) * _power(_BASE_INVERSE, "down", high - low)[s]
        at = upto
    return _mix(out + (end - start).astype(np.uint64))


def split_words(raw: np.ndarray, marks: np.ndarray) -> Words:
    """The words of the rows of ``raw`` that ``marks`` delimits."""
    low, high = int(marks[0]), int(marks[-1])
    raw = LOWER[raw[low:high]]
    marks = marks - low
    inside = WORD_BYTES[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[marks] = True
    before = np.zeros(len(raw), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(raw), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    row = np.searchsorted(marks, start, side="right") - 1
    return Words(raw, start, end, hash_ranges(raw, start, end), row)


def gram_hashes(words: Words, n: int) -> np.ndarray:
    """A hash of the n words from each position on, for positions where n words are left."""
    h, many = words.hashes, len(words.hashes) - n + 1
    if many <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(many, dtype=np.uint64)
    for j in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[j : j + many]
    return _mix(out + np.uint64(n))


def window_starts(words: Words, n: int) -> np.ndarray:
    """Positions from which n words lie in one row."""
    many = len(words.row) - n + 1
    if many <= 0:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(words.row[:many] == words.row[n - 1 :])


def winnow(words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the windows of WINDOW words at ``starts``, thinned: ``(hashes, positions, of)``.

    ``hashes`` and ``positions`` have each chosen k-gram once, however many windows choose it; ``of`` says for each
    window which one it chose.
    """
    grams = gram_hashes(words, K)
    least, at = np.full(len(starts), np.iinfo(np.uint64).max, dtype=np.uint64), np.zeros(len(starts), np.int64)
    for j in range(WINDOW - K + 1):
        own = grams[starts + j]
        last = own <= least
        least[last], at[last] = own[last], (starts + j)[last]
    positions, of = np.unique(at, return_inverse=True)
    return grams[positions], positions, of


_WINDOW_FIELDS = [
    T.StructField("n", T.IntegerType()),
    T.StructField("fingerprint", T.LongType()),
    T.StructField("window", T.LongType()),
    T.StructField("words", T.StringType()),
]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Distinct windows of the items with the sorted ids of the items that have them."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("item", T.StringType()), *_WINDOW_FIELDS])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, marks = utf8_parts(batch.column(1))
            for first, last in row_groups(marks, _SLICE):
                words = split_words(raw, marks[first : last + 1])
                counts = np.bincount(words.row, minlength=last - first)
                long = window_starts(words, WINDOW)
                prints, _, of = winnow(words, long)
                found = [(long, WINDOW, prints[of], gram_hashes(words, WINDOW)[long] if len(long) else long.view(np.uint64))]
                for n in np.unique(counts[(counts > 0) & (counts < WINDOW)]):
                    starts = window_starts(words, int(n))
                    starts = starts[counts[words.row[starts]] == n]
                    whole = gram_hashes(words, int(n))[starts]
                    found.append((starts, int(n), whole, whole))
                for starts, n, prints, hashes in found:
                    if len(starts):
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column(0).slice(first, last - first).take(pa.array(words.row[starts])),
                                pa.array(np.full(len(starts), n, np.int32)),
                                _signed(prints),
                                _signed(hashes),
                                pa.array([words.text(int(s), n) for s in starts], pa.string()),
                            ],
                            names=schema.names,
                        )

    return rows.mapInArrow(emit, schema).groupBy("n", "fingerprint", "window", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Bits:
    """A bitmap on the highest bits of hashes: what it does not have is in no benchmark."""

    def __init__(self, hashes: DataFrame, many: int) -> None:
        """From ``hashes(hash)``, set together by Spark: at most one row for each 64 bits of the map reaches the driver."""
        self.width = min(MAX_FILTER_BITS, max(16, (FILTER_BITS_EACH * max(1, many)).bit_length()))
        slot = F.shiftrightunsigned("hash", 64 - self.width)
        bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
        rows = hashes.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
        self.words = np.zeros(1 << self.width - 6, np.uint64)
        self.words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        slots = hashes >> np.uint64(64 - self.width)
        return (self.words[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in order of their start, joined where they touch or overlap."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """Which words of each document lie in an occurrence of a benchmark window.

    Returns one row for each row of ``docs``: ``<id_col>``, ``n_words``, ``n_hit``, ``spans`` (array of
    struct<start, end>: merged word ranges that are hit, end exclusive) and ``items`` (array of the ids,
    as sorted strings, of items with an occurring window). Words are lower-cased (A-Z only) runs of
    digits, letters and non-ASCII characters.

    Defined cases: a null or empty text has no words and no hits; a very long text is read in one piece; an item
    without words has no window; an item of fewer than ``WINDOW`` words is one window; equal documents or items are
    counted each by itself, also when they share an id; a null item id is left out of ``items`` though its words
    count as hit; an empty benchmark hits nothing; an empty table gives no rows; other columns are not read.

    One scan of ``docs``. Windows whose fingerprint and hash two bitmaps of bounded size know go to the join, and
    no others; the benchmark's windows are broadcast up to ``max_broadcast`` bytes, beyond, the join shuffles.
    Rows are told apart by id and a digest of the text, so that it does not matter in which order they come.
    """
    tune(docs.sparkSession)
    windows = _benchmark_windows(benchmark, item_col, item_text_col)
    texts = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col)), F.lit(0)).alias("bytes")).first().bytes
    # Windows of the same items share the list of them.
    windows = windows.withColumn("set", F.sha2(F.encode(F.to_json("items"), "UTF-8"), 256))
    windows = checkpointed(windows.coalesce(max(1, -(-texts // PART_BYTES))))
    size = windows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("words") + 120), F.lit(0)).alias("bytes")).first()
    sets = windows.groupBy("set").agg(F.first("items").alias("items"))
    listed = sets.agg(F.coalesce(F.sum(80 + 24 * F.size("items")), F.lit(0)).alias("bytes")).first().bytes
    known = _Bits(windows.select(F.col("fingerprint").alias("hash")), size.rows)
    exact = _Bits(windows.select(F.col("window").alias("hash")), size.rows)
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("start", T.LongType()), *_WINDOW_FIELDS])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, marks = utf8_parts(batch.column(1))
            data = memoryview(raw)
            for first, last in row_groups(marks, _SLICE):
                own = marks[first : last + 1]
                words = split_words(raw, own)
                many = last - first
                digests = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
                ids, keys = batch.column(0).slice(first, many), pa.array(digests, pa.binary())
                n_words = np.bincount(words.row, minlength=many)
                # The row of a document itself: it matches no window (n = -1) and its key spreads it.
                spread = pa.array(np.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], np.int64))
                yield pa.RecordBatch.from_arrays([ids, keys, pa.array(n_words, pa.int64()), pa.nulls(many, pa.int64()), pa.array(np.full(many, -1, np.int32)), spread, spread, pa.array([""] * many, pa.string())], names=schema.names)
                first_word = np.concatenate([[0], np.cumsum(n_words)])
                for n in lengths:
                    starts = window_starts(words, n)
                    if not len(starts):
                        continue
                    whole = gram_hashes(words, n)
                    if n < WINDOW:
                        starts = starts[known.of(whole[starts])]
                        prints = whole[starts]
                    else:
                        # Each chosen fingerprint is looked up once, and those known are extended to their windows.
                        chosen, _, of = winnow(words, starts)
                        kept = known.of(chosen)[of]
                        starts, prints = starts[kept], chosen[of[kept]]
                    real = exact.of(whole[starts])
                    starts, prints = starts[real], prints[real]
                    for a in range(0, len(starts), 20_000):
                        s = starts[a : a + 20_000]
                        row = pa.array(words.row[s])
                        yield pa.RecordBatch.from_arrays(
                            [
                                ids.take(row),
                                keys.take(row),
                                pa.nulls(len(s), pa.int64()),
                                pa.array(s - first_word[words.row[s]], pa.int64()),
                                pa.array(np.full(len(s), n, np.int32)),
                                _signed(prints[a : a + 20_000]),
                                _signed(whole[s]),
                                pa.array([words.text(int(x), n) for x in s], pa.string()),
                            ],
                            names=schema.names,
                        )

    found = rows.mapInArrow(emit, schema)
    right = windows.select("n", "fingerprint", "window", F.col("words").alias("item_words"), "set")
    if size.bytes <= max_broadcast:
        right = F.broadcast(right)
    joined = found.join(right, on=[found.n == right.n, found.fingerprint == right.fingerprint, found.window == right.window, found.words == right.item_words], how="left")
    hit = F.when(F.col("set").isNotNull(), F.struct(F.col("start"), (F.col("start") + found.n).alias("end")))
    grouped = joined.groupBy("id", "digest").agg(
        F.count("n_words").cast("int").alias("copies"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("hits"), F.collect_set("set").alias("sets")
    )
    spread = grouped.withColumn("set", F.explode_outer("sets"))
    shown = spread.join(F.broadcast(sets) if listed <= max_broadcast else sets, "set", "left").groupBy("id", "digest").agg(
        F.first("copies").alias("copies"), F.first("n_words").alias("n_words"), F.first("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    each = shown.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select("id", "n_words", "hits", "items")
    out = T.StructType([T.StructField(id_col, id_type), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])

    def join_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            flat = hits.flatten()
            first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            ends = np.cumsum(hits.value_lengths().to_numpy(zero_copy_only=False))
            spans = [merged(first[b - n : b], last[b - n : b]) for b, n in zip(ends.tolist(), hits.value_lengths().to_pylist())]
            offsets = np.concatenate([[0], np.cumsum([len(a) for a, _ in spans])]).astype(np.int32)
            joined = pa.StructArray.from_arrays([pa.array(np.concatenate([x[i] for x in spans] or [first])) for i in range(2)], fields=list(_SPAN))
            n_hit = pa.array([int((b - a).sum()) for a, b in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_hit, pa.ListArray.from_arrays(pa.array(offsets), joined), batch.column(3)], names=out.names)

    return each.mapInArrow(join_ranges, out)
