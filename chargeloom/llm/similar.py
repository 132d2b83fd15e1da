"""Near copies by five-word shingles: SimHash compared bit-sliced inside blocks, each pair confirmed on whole sets.

Two texts are near copies when the sets of their word shingles have a Jaccard similarity of ``SIMILARITY`` or more.
At 0.8 their fingerprints differ in about 10 of 64 bits, which no band of equal bits finds: blocks are made of
texts that agree on the smallest of ``ROWS`` hashings of their shingles instead, in one of ``BANDS`` such draws. Two
texts of similarity s meet in a block with probability 1 - (1 - s^ROWS)^BANDS, which is 0.997 at 0.8 and rises
from there, and fingerprints of similar texts are within ``RADIUS`` bits with about the same one. No block and no
candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import release
from .common import checkpointed, tune, utf8_parts
from .components import components
from .simhash import BLOCK, PAIRS_A_ROW, block_pairs, dealt, majority, pairs_within, shingle_hashes

SHINGLE = 5
SIMILARITY = Fraction(4, 5)
BANDS, ROWS = 8, 3
RADIUS = 18

#: Up to so many ids are broadcast to fetch their texts; beyond, the join shuffles.
MAX_BROADCAST_IDS = 500_000
#: A sub-block of a crowded block holds about so many bytes of shingle hashes.
BLOCK_BYTES = 1 << 20

_SLICE = 1 << 14
_rng = np.random.default_rng(17)
_ODD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(raw: bytes) -> bytes:
    """The lower-cased words of a UTF-8 text, joined by single spaces."""
    return " ".join(raw.decode("utf-8", "surrogateescape").lower().split()).encode("utf-8", "surrogateescape")


def _texts(column: pa.Array) -> Iterator[bytes]:
    raw, marks = utf8_parts(column)
    data = memoryview(raw)
    return (normal(bytes(data[a:b])) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist()))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each band: the smallest of the hashes under ROWS multiplications, folded together."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _SLICE):
        np.minimum(least, (_ODD[:, None] * hashes[None, at : at + _SLICE]).min(axis=1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    return keys


def _hashed(docs: DataFrame, shingle: int) -> DataFrame:
    """``id``, digest of the words, fingerprint and band keys (none without words) of each row of ``docs(id, text)``."""
    schema = T.StructType.fromDDL("id long, digest binary, fp long, keys array<long>")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, keys = [], [], []
            for text in _texts(batch.column(1)):
                hashes = shingle_hashes(text, shingle)
                digests.append(xxhash.xxh3_128_digest(text))
                prints.append(majority(hashes))
                keys.append(band_keys(hashes).view(np.int64) if len(hashes) else np.zeros(0, np.int64))
            fps = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), fps, pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(emit, schema)


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id`` and the sorted distinct shingle hashes (as bytes) of the rows of ``docs(id, text)`` that ``ids(id)`` names."""
    ids = checkpointed(ids.distinct())
    few = ids.count() <= MAX_BROADCAST_IDS
    schema = T.StructType.fromDDL("id long, hashes binary")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text, shingle)).tobytes() for text in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=schema.names)

    return checkpointed(docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "text").mapInArrow(emit, schema))


def _confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """The pairs ``(u, v)`` of ids whose texts in ``docs(id, text)`` are similar, by their whole sets of shingles."""
    pairs = checkpointed(pairs)
    sets = _sets(docs, pairs.select(F.col("u").alias("id")).union(pairs.select("v")), shingle)
    both = pairs.join(sets.toDF("v", "right"), "v").join(sets.toDF("u", "left"), "u").select("u", "v", "left", "right")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared * similarity.denominator >= similarity.numerator * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["u", "v"])

    return checkpointed(both.mapInArrow(confirm, "u long, v long"))


def spanning_pairs(values: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], radius: int, similarity: Fraction) -> list[tuple[int, int]]:
    """Positions of similar texts of one block, fewer than its texts, that join what any of its similar pairs join.

    ``labels`` name what is joined already; a candidate of the bit-sliced comparison whose labels have met by then
    is not looked at.
    """
    labels = np.unique(labels, return_inverse=True)[1]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    marks = np.concatenate([[0], np.cumsum(sizes)])
    spots = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own, out = np.zeros(spots.max() + 1, bool), []
    for left, right in pairs_within(values, labels, radius):
        cuts = np.flatnonzero(np.diff(left, prepend=-1, append=-1))
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            one, others = int(left[at]), right[at:end]
            others = others[labels[others] != labels[one]]
            if not len(others):
                continue
            mine = spots[marks[one] : marks[one + 1]]
            own[mine] = True
            # The others are after this one, so sums are made from its end on.
            shared = np.add.reduceat(own[spots[marks[one + 1] :]], marks[one + 1 : -1] - marks[one + 1], dtype=np.int64)[others - one - 1]
            own[mine] = False
            others = others[shared * similarity.denominator >= similarity.numerator * (sizes[one] + sizes[others] - shared)]
            met, first = np.unique(labels[others], return_index=True)
            out += [(one, int(x)) for x in others[first]]
            labels[np.isin(labels, met)] = labels[one]
    return out


def _confirmed_in_blocks(docs: DataFrame, rows: DataFrame, shingle: int, similarity: Fraction, radius: int, block: int, block_bytes: int) -> DataFrame:
    """Pairs ``(u, v)`` that join the near copies of each key of ``rows(key, id, fp, label)``: fewer than it has rows.

    The whole sets of the texts go where the blocks are, in sub-blocks of about ``block_bytes`` bytes, so a group of texts of
    which many are nearly similar is compared without a row for each two of them.
    """
    rows = checkpointed(rows)
    full = rows.join(_sets(docs, rows.select("id"), shingle), "id")
    blocks = dealt(full, ["id", "fp", "label", "hashes"], block, by="id", weight=F.length("hashes"), most=block_bytes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, values, labels = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(4)[row].values]
                found = spanning_pairs(values.view(np.uint64), labels, sets, radius, similarity)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[a]) for a, _ in found], pa.int64()), pa.array([int(ids[b]) for _, b in found], pa.int64())], names=["u", "v"])

    return checkpointed(blocks.mapInArrow(emit, "u long, v long"))


def near_copies(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: Fraction = SIMILARITY,
    radius: int = RADIUS,
    block: int = BLOCK,
    block_bytes: int = BLOCK_BYTES,
    pairs_a_row: int = PAIRS_A_ROW,
) -> DataFrame:
    """``<id_col>`` (long) and ``component`` of each row of ``docs`` that a chain of near copies joins with another.

    ``id_col`` must be unique and not null. A component is named by the smallest id in it. Words are what is left
    between white space after lower-casing; a text of fewer words than ``shingle`` is one shingle, and texts
    without words (null, empty, white space) are copies of each other alone. Sets are compared by the 64-bit hashes
    of their shingles, whatever a text's length. Texts of equal words are reduced to one first, so repeats and large
    groups of copies cost a row each. An empty table gives no rows; other columns are not read.

    A block is first compared with its smallest id alone, which settles a block of copies of one text; only texts
    that this leaves in different components meet each other, bit-sliced, in sub-blocks of ``block``. Where that finds
    more than ``pairs_a_row`` candidates a row, they are confirmed inside the block and only joining pairs leave it:
    the plan differs, the result does not.
    """
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    hashed = checkpointed(_hashed(docs, shingle))
    texts = checkpointed(hashed.groupBy("digest").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows")))

    marks = texts.select("id", "fp", F.explode("keys").alias("key"))
    heads = marks.groupBy("key").agg(F.min(F.struct("id", "fp")).alias("head"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("key", "head")
    shared = checkpointed(marks.join(heads, "key"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("head.fp"))) <= radius
    first = shared.filter((F.col("id") != F.col("head.id")) & near).select(F.col("head.id").alias("u"), F.col("id").alias("v")).distinct()
    roots = components(_confirmed(docs, first, shingle, similarity))
    release(docs.sparkSession)

    labelled = shared.join(roots, shared["id"] == roots["node"], "left").select("key", "id", "fp", F.coalesce("root", "id").alias("label"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    opened = checkpointed(labelled.join(open_, "key", "left_semi"))
    second = checkpointed(block_pairs(opened, radius, block, pairs_a_row))
    release(docs.sparkSession)
    tried = second.filter("crowded is null").select("u", "v").distinct().join(first, ["u", "v"], "left_anti")
    links = roots.toDF("u", "v").union(_confirmed(docs, tried, shingle, similarity))
    crowded = checkpointed(second.filter("crowded is not null").select(F.col("crowded").alias("key")).distinct())
    if crowded.count():
        links = links.union(_confirmed_in_blocks(docs, opened.join(crowded, "key", "left_semi"), shingle, similarity, radius, block, block_bytes))
    linked = components(links)
    release(docs.sparkSession)

    named = texts.join(linked, texts["id"] == linked["node"], "left").select("digest", "rows", F.coalesce("root", "id").alias("component"))
    several = named.groupBy("component").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("component")
    named = checkpointed(named.join(several, "component").select("digest", "component"))
    return checkpointed(hashed.select("id", "digest").join(named, "digest").select(F.col("id").alias(id_col), "component"))
