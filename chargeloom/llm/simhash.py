"""Near-duplicates by 64-bit SimHash, compared bit-sliced inside blocks of equal bands.

Fingerprints within ``radius`` bits agree on all but ``radius`` of ``radius + 2`` bands, so two bands at
least are equal: every pair of bands is a block key, and each block is compared in full. In a block the
fingerprints are stored as vertical bit planes; carry-save counters add one plane after another to all
distances at once, and a block is given up when every counter has passed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, tune, utf8_parts
from .components import components

SEED = 42
SHINGLE = 3
RADIUS = 2

#: Fingerprints that one block compares; a key with more is dealt over pairs of sub-blocks.
BLOCK = 2048
#: A block with more candidate pairs a row than this lists none of them; its texts are compared where the block is.
PAIRS_A_ROW = 2

_COUNT_ROWS = 1 << 16
_SMALL = 32


def shingle_hashes(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The XXH64 of each word shingle of a UTF-8 text, repeats included; a shorter text is one shingle."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    many = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:many].tolist(), ends[width - 1 :].tolist())), np.uint64, many)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; zero for none."""
    many = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, many, _COUNT_ROWS):
        bits = np.unpackbits(hashes[at : at + _COUNT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > many, bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: majority bits of the XXH64 of its word shingles, repeats included."""
    return majority(shingle_hashes(raw, shingle, seed))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) for each row of ``docs``."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("fp", T.LongType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, marks = utf8_parts(batch.column(1))
            data = memoryview(raw)
            prints = np.fromiter((fingerprint(bytes(data[a:b]), shingle) for a, b in zip(marks[:-1].tolist(), marks[1:].tolist())), np.uint64, len(marks) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(emit, schema)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows of packed bits: bit i of row b is bit b of value i."""
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    padded = np.zeros((64, -(-len(values) // 64) * 64), dtype=np.uint8)
    padded[:, : len(values)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(a: np.ndarray, b: np.ndarray, radius: int, every: int = 8) -> np.ndarray | None:
    """Packed flags of the positions where planes ``a`` and ``b`` (broadcast) differ in at most ``radius`` bits.

    ``counters[i]`` holds bit i of all distances. A carry out of the last counter, or a value over the
    radius, marks a position as passed; None when all are, however few planes were read.
    """
    width = (radius + 1).bit_length()
    counters, passed = None, None
    for i in range(64):
        carry = a[i] ^ b[i]
        if counters is None:
            counters = [np.zeros_like(carry) for _ in range(width)]
            passed = np.zeros_like(carry)
        for c in counters:
            spare = c & carry
            np.bitwise_xor(c, carry, out=c)
            carry = spare
        passed |= carry
        if i % every == every - 1:
            if (passed | _over(counters, radius)).min() == np.iinfo(np.uint64).max:
                return None
    return ~(passed | _over(counters, radius))


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Positions whose counter is larger than ``radius``: compared from the highest bit down."""
    over, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            over = over | (equal & counters[k])
            equal = equal & ~counters[k]
    return over


def _flags(packed: np.ndarray, many: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(packed).view(np.uint8), axis=-1, bitorder="little")[..., :many].astype(bool)


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the pairs (a, b): the smallest index that each index is linked with."""
    while len(a):
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(labels, high[open_], low[open_])
        while (labels != (further := labels[labels])).any():
            labels = further
    return labels


def group_labels(values: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For each value the first index that it is linked with inside its group (groups lie together)."""
    labels = np.arange(len(values))
    bounds = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1))
    sizes = np.diff(bounds)
    place = np.repeat(np.arange(len(sizes)), sizes)
    small = np.flatnonzero(sizes[place] <= _SMALL)
    small = small[np.argsort(-sizes[place[small]], kind="stable")]
    for apart in range(1, min(_SMALL, int(sizes[place[small]].max()) if len(small) else 0)):
        few = small[: int(np.searchsorted(-sizes[place[small]], -apart, side="left"))]
        left, right = few[:-apart], few[apart:]
        same = place[left] == place[right]
        left, right = left[same], right[same]
        if not len(left):
            continue
        packed = within(bit_planes(values[left]), bit_planes(values[right]), radius)
        if packed is not None:
            near = _flags(packed, len(left))
            labels = _join(labels, left[near], right[near])
    for g in np.flatnonzero(sizes > _SMALL):
        low, many = int(bounds[g]), int(sizes[g])
        planes = bit_planes(values[low : low + many])[:, None, :]
        every = np.uint64(0) - (values[low : low + many][None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1))
        for at in range(0, many, 256):
            packed = within(planes[:, :, at // 64 :], every[:, at : at + 256, None], radius)
            if packed is not None:
                a, b = np.nonzero(_flags(packed, many - at // 64 * 64))
                labels = _join(labels, a + low + at, b + low + at // 64 * 64)
    return labels


def dealt(rows: DataFrame, columns: list[str], block: int, by: str = "fp", weight: Column | None = None, most: int = 0) -> DataFrame:
    """Blocks of ``rows(key, ...)`` as one row of ``key`` and arrays of ``columns``; a key with more than ``block`` rows, or
    whose rows have a ``weight`` of over ``most``, is dealt by ``by`` over pairs of sub-blocks, so that every two of its
    rows meet in one."""
    parts = F.ceil(F.col("n") / block)
    total = F.sum(weight) if weight is not None else F.lit(0)
    if weight is not None:
        parts = F.greatest(parts, F.ceil(F.col("total") / most))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), total.alias("total")).filter("n > 1").select("key", parts.cast("int").alias("parts"))
    spread = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    grouped = spread.groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("rows"))
    return grouped.filter(F.size("rows") > 1).select("key", *(F.col(f"rows.{c}").alias(c) for c in columns))


def links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges ``(u, v)`` of ids that span, in each block, what lies within ``radius`` bits.

    ``prints(fp, id)`` holds each fingerprint once. Fingerprints linked in a block are tied to the
    smallest of their ids, so a block has fewer edges than rows, yet no link is lost.
    """
    bands = radius + 2
    bounds = [64 * i // bands for i in range(bands + 1)]
    band = [F.shiftrightunsigned("fp", bounds[i]).bitwiseAND(F.lit((1 << bounds[i + 1] - bounds[i]) - 1)) for i in range(bands)]
    keys = F.array(*(F.struct(F.lit(n).alias("table"), band[i].alias("a"), band[j].alias("b")) for n, (i, j) in enumerate(combinations(range(bands), 2))))
    blocks = dealt(prints.select("fp", "id", F.explode(keys).alias("key")), ["id", "fp"], block).select("id", "fp")
    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            group = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
            labels = group_labels(values, group, radius)
            tied = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[labels[tied]])], names=schema.names)

    return blocks.mapInArrow(emit, schema)


def pairs_within(values: np.ndarray, labels: np.ndarray, radius: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of one block, smaller first, whose values differ in at most ``radius`` bits and whose labels differ."""
    many = len(values)
    planes = bit_planes(values)[:, None, :]
    every = np.uint64(0) - (values[None, :] >> np.arange(64, dtype=np.uint64)[:, None] & np.uint64(1))
    for at in range(0, many, rows):
        packed = within(planes[:, :, at // 64 :], every[:, at : at + rows, None], radius)
        if packed is None:
            continue
        a, b = np.nonzero(_flags(packed, many - at // 64 * 64))
        a, b = a + at, b + at // 64 * 64
        new = (a < b) & (labels[a] != labels[b])
        yield a[new], b[new]


def block_pairs(rows: DataFrame, radius: int, block: int = BLOCK, most: int = PAIRS_A_ROW) -> DataFrame:
    """Pairs ``(u, v)`` of ids, u < v, that share a key, differ in at most ``radius`` bits and have different labels.

    ``rows(key, fp, id, label)``, with a long key; ids of one label are known to belong together and are not paired.
    A block in which more than ``most`` pairs a row are found gives none, but a row with its key as ``crowded``.
    """
    schema = T.StructType.fromDDL("u long, v long, crowded long")
    arrow = pa.schema([(name, pa.int64()) for name in schema.names])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, crowded = [], [], []
            for row in range(batch.num_rows):
                ids, values, labels = (batch.column(i)[row].values.to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                found, left = [], most * len(ids)
                for a, b in pairs_within(values.view(np.uint64), labels, radius):
                    left -= len(a)
                    if left < 0:
                        crowded.append(batch.column(0)[row].as_py())
                        break
                    found.append((ids[a], ids[b]))
                else:
                    us += [a for a, _ in found]
                    vs += [b for _, b in found]
            u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (us, vs))
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], schema=arrow)
            if crowded:
                none = pa.nulls(len(crowded), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(crowded, pa.int64())], schema=arrow)

    return dealt(rows, ["id", "fp", "label"], block).mapInArrow(emit, schema)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``<id_col>`` (long), ``fp`` (signed long) and ``component_id`` for each row of ``docs``.

    A component is all documents that a chain of links joins; its id is the smallest document id in it.

    Equal fingerprints are reduced to one before anything is compared, so copies cost one row, and a block
    key that many fingerprints share is dealt over pairs of sub-blocks of ``block``. Nothing is capped.

    Defined cases: a text without words (null, empty, white space) has fingerprint zero and is linked like
    any other; a very long text is hashed whole; repeated rows each get a row; rows without an id keep their
    fingerprint, link nothing and get a null component; an empty table gives no rows; other columns are not read.
    """
    tune(docs.sparkSession)
    hashed = checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    prints = checkpointed(hashed.filter("id is not null").groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(links(prints, radius, block))
    named = prints.join(roots, prints.id == roots.node, "left").select("fp", F.coalesce("root", "id").alias("component"))
    return hashed.join(named, "fp", "left").select(
        F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id")
    )
