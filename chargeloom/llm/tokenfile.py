"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

A token store is a folder of three Parquet tables, so that any store Spark can reach can hold it:

``dictionary``  one row: ``dict_hash`` (SHA-256 of the dictionary, empty without one), ``dictionary``, ``width``
``blocks``      one row for each block: ``shard``, ``block``, ``first_id``, ``last_id``, ``before`` (ids of the
                shard's blocks before), ``dict_hash``, ``doc_ids``, ``offsets`` (one more than
                documents), ``counts`` (ids of each document) and ``payload`` (the frames one after another)
``shards``      one row for each shard: ``shard`` and ``start`` (ids of all documents before it)

A document's ids are little-endian integers of ``width`` bytes in a zstandard frame of their own. One
document is read by its block (Parquet statistics on first_id and last_id prune the others) and its offset,
and only its frame is decompressed.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import UNSETTLED, byte_characters
from .common import claim, hash_share, texts_of, tune

END_ID = 2

#: The dictionary: trained on at most so many documents (smallest hash of the id) of at most so many bytes.
MAX_SAMPLES = 2_000
MAX_SAMPLE_BYTES = 8_192
DICTIONARY_BYTES = 64 << 10

#: A block holds about so many compressed bytes, a shard about so many documents.
BLOCK_BYTES = 1 << 20
SHARD_DOCS = 20_000
#: Cuts that one sketch of the ids gives; two levels of them make up to 16 million shards.
CUTS_A_LEVEL = 4096

_LEVEL = 3
_GOLDEN = 0.6180339887498949
#: Longer texts without a space are left to the tokenizers library whole.
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}").search


class Encoder:
    """Ids of texts as the tokenizers library gives them, as unsigned integers of ``width`` bytes (2 if all ids fit).

    Where a file's merges are numbered in their order, as byte-level files have them, they are ranks too, and
    tiktoken merges by ranks several times as fast as the tokenizers library. It is used for texts whose characters
    both libraries' tables agree on (up to U+052F); all others, texts that hold a special token and very long runs
    without a space go to the tokenizers library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.ranks = _ranked(json.load(f))

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special) or (not text.isascii() and UNSETTLED(text)) or _LONG_RUN(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return array(self.code, ids).tobytes()


def _ranked(spec: dict) -> tiktoken.Encoding | None:
    """The merges of a byte-level tokenizer file as ranks; None if its form is another one."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec["normalizer"]
    if model["type"] != "BPE" or not plain or model.get("ignore_merges") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    merges = [m if not isinstance(m, str) else m.split(" ") for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(merges) + 256 != len(set(model["vocab"]) - added):
        return None
    byte_of = {c: b for b, c in byte_characters().items()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def load(path: str) -> Encoder:
    """The encoder of a file, once for each worker."""
    claim("tokenfile", _encoder.cache_clear)
    return _encoder(path)


def _packed(encoder: Encoder, texts: list[str], end_id: int) -> list[bytes]:
    """The id arrays of texts, each with the end id behind it, as they are written."""
    end = array(encoder.code, [end_id]).tobytes()
    return [encoder.encode(text) + end for text in texts]


def train_dictionary(docs: DataFrame, path: str, *, id_col: str, text_col: str, end_id: int) -> bytes:
    """A dictionary trained on the id arrays of a bounded sample of short documents; empty if there are too few.

    Only short documents gain by a dictionary, so the sample is of those whose text has at most
    ``MAX_SAMPLE_BYTES`` bytes; it is at most ``MAX_SAMPLES * MAX_SAMPLE_BYTES`` bytes of text.
    """
    short = docs.select(F.col(id_col).alias("id"), F.octet_length(text_col).alias("size")).filter(F.col("size").between(1, MAX_SAMPLE_BYTES) & F.col("id").isNotNull()).select("id")
    total = short.count()
    share = min(1.0, (4 * MAX_SAMPLES + 1000) / max(1, total))
    chosen = short.distinct().filter(hash_share("id") <= share).orderBy(hash_share("id"), "id").limit(MAX_SAMPLES)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= MAX_SAMPLE_BYTES).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _packed(load(path), texts_of(batch.column(1)), end_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=schema.names)

    samples = [bytes(r.ids) for r in rows.select("id", "text").mapInArrow(emit, schema).orderBy("id", "ids").limit(2 * MAX_SAMPLES).collect()]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # samples that have nothing in common
        return b""


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if not dictionary:
        return zstandard.ZstdCompressor(level=_LEVEL)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=_LEVEL)
    return zstandard.ZstdCompressor(level=_LEVEL, dict_data=shared)


def _shard_bounds(docs: DataFrame, id_col: str, shard_docs: int = SHARD_DOCS, most_cuts: int = CUTS_A_LEVEL) -> list[int]:
    """Ids that split the documents into shards of about ``shard_docs``, from the id column alone.

    An id that many rows share stands in the list as often as it fills a shard. One sketch gives at most ``most_cuts``
    cuts; where more are needed, each range between two of them is cut again, by a sketch of its own.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    many = ids.count()
    shards = max(1, -(-many // shard_docs))
    # Never fewer shards than cores, so that small inputs are spread too.
    shards = max(shards, min(ids.sparkSession.sparkContext.defaultParallelism, -(-many // 1000)))
    if shards == 1:
        return []
    known = ids.select(F.coalesce("id", F.lit(np.iinfo(np.int64).min)).alias("id"))
    first = min(shards, most_cuts)
    cuts = sorted(known.select(_quantiles(first).alias("cuts")).first().cuts or [])
    if first == shards:
        return cuts
    inner = min(most_cuts, -(-shards // first))
    edges = np.unique(np.array(cuts, np.int64))

    @F.arrow_udf(T.IntegerType())
    def span(column: pa.Array) -> pa.Array:
        values = column.to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(edges, values, side="left") + np.searchsorted(edges, values, side="right"), pa.int32())

    # Odd spans are one id, which stands as often as it fills a shard; even ones lie between two.
    spans = known.groupBy(span("id").alias("span")).agg(_quantiles(inner).alias("cuts"), F.first("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    own = F.array_repeat("id", (1 + F.col("rows") / shard_docs).cast("int"))
    within = spans.select(F.explode(F.when(F.col("span") % 2 == 1, own).otherwise(F.col("cuts"))).alias("cut"))
    return sorted(r.cut for r in within.toLocalIterator())


def _quantiles(parts: int) -> Column:
    """The ids that cut a column ``id`` into ``parts`` of about equal rows."""
    return F.percentile_approx("id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts)


def _shards(bounds: np.ndarray, ids: np.ndarray, ties: np.ndarray, seen: Counter | None = None) -> np.ndarray:
    """The shard of each row, ascending in id: rows of an id that fills several shards are dealt over them.

    They are dealt by the tie and, where a task meets an (id, tie) again, by how often: so equal rows, which are
    alike to every reader, are dealt too, and a task that runs again deals the same rows to the same shards, in
    whatever order it reads them. ``seen`` counts for the task.
    """
    first, last = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    seen = Counter() if seen is None else seen
    several = np.flatnonzero(last > first)
    share = np.zeros(len(ids))
    for i, key in zip(several.tolist(), zip(ids[several].tolist(), ties[several].tolist())):
        share[i] = (key[1] / 2.0**32 + seen[key] * _GOLDEN) % 1.0
        seen[key] += 1
    return (first + (share * (last - first + (last > first))).astype(np.int64)).astype(np.int32)


def write_tokens(
    docs: DataFrame,
    folder: str,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_bytes: int = BLOCK_BYTES,
) -> None:
    """Encode ``docs`` and write a token store to ``folder``, documents in ascending order of id.

    Null ids come first, and rows with the same id in some order (that of their ids' checksum within a shard); a null or empty
    text is its end id alone, a very long one is one frame like others. Repeated rows are each written; other
    columns are not read. Documents are encoded and compressed where they are read, and only frames are shuffled:
    by shard, cut at quantiles of the ids, and sorted within it; an id that many rows share is spread over several
    shards, equal rows too. An empty table makes a store without blocks.
    """
    spark = docs.sparkSession
    tune(spark)
    width = load(path).width
    dictionary = train_dictionary(docs, path, id_col=id_col, text_col=text_col, end_id=end_id)
    dict_hash = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    spark.createDataFrame([(dict_hash, dictionary, width)], "dict_hash string, dictionary binary, width int").coalesce(1).write.parquet(f"{folder}/dictionary")

    bounds = np.array(_shard_bounds(docs, id_col), np.int64)
    frames_schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("tie", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("frame", T.BinaryType())])

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = _compressor(dictionary), Counter()
        for batch in batches:
            packed = _packed(load(path), texts_of(batch.column(1)), end_id)
            ids = batch.column(0)
            ties = np.array([zlib.crc32(x) for x in packed], np.int64)
            shards = _shards(bounds, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), ties, seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards, pa.int32()), ids, pa.array(ties), pa.array([len(x) // width for x in packed], pa.int32()), pa.array([press.compress(x) for x in packed], pa.binary())],
                names=frames_schema.names,
            )

    frames = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(compress, frames_schema)
    dealt = frames.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "tie", "frame").drop("tie")
    long, whole = T.LongType(), T.IntegerType()
    blocks_schema = T.StructType(
        [
            T.StructField("shard", whole),
            T.StructField("block", whole),
            T.StructField("first_id", long),
            T.StructField("last_id", long),
            T.StructField("before", long),
            T.StructField("dict_hash", T.StringType()),
            T.StructField("doc_ids", T.ArrayType(long)),
            T.StructField("offsets", T.ArrayType(whole)),
            T.StructField("counts", T.ArrayType(whole)),
            T.StructField("payload", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"shard": None, "block": 0, "before": 0}
        ids: list[int | None] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def block() -> pa.RecordBatch:
            known = [x for x in ids if x is not None]
            row = {
                "shard": state["shard"],
                "block": state["block"],
                "first_id": known[0] if len(known) == len(ids) else None,
                "last_id": known[-1] if known else None,
                "before": state["before"],
                "dict_hash": dict_hash,
                "doc_ids": list(ids),
                "offsets": np.concatenate([[0], np.cumsum([len(x) for x in frames])]).tolist(),
                "counts": list(counts),
                "payload": b"".join(frames),
            }
            state["block"] += 1
            state["before"] += sum(counts)
            ids.clear(), counts.clear(), frames.clear()
            return pa.RecordBatch.from_pylist([row], schema=_blocks_arrow)

        held = 0
        for batch in batches:
            for shard, key, n, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (shard != state["shard"] or held + len(frame) > block_bytes):
                    yield block()
                    held = 0
                if shard != state["shard"]:
                    state |= {"shard": shard, "block": 0, "before": 0}
                ids.append(key), counts.append(n), frames.append(frame)
                held += len(frame)
        if ids:
            yield block()

    # The frames are compressed already.
    dealt.mapInArrow(pack, blocks_schema).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    written = spark.read.parquet(f"{folder}/blocks")
    totals = written.groupBy("shard").agg(F.max(F.struct("before", F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("own"))).alias("last"))
    # One row a shard: the only global order, over (documents / SHARD_DOCS) numbers.
    totals.selectExpr("shard", "sum(last.before + last.own) over (order by shard) - (last.before + last.own) as start").coalesce(1).write.parquet(f"{folder}/shards")


_blocks_arrow = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("first_id", pa.int64()),
        ("last_id", pa.int64()),
        ("before", pa.int64()),
        ("dict_hash", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int32())),
        ("payload", pa.binary()),
    ]
)


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.dictionary or b"")
    if data and hashlib.sha256(data).hexdigest() != row.dict_hash:
        raise ValueError(f"the dictionary of {folder} does not have its hash")
    return row.dict_hash, data, row.width


def read_tokens(spark: SparkSession, folder: str, *, doc_id: int | None = None, with_ids: bool = True) -> DataFrame:
    """The documents of a token store: ``doc_id``, ``start``, ``n_tokens``, ``crc32`` and (``with_ids``) ``ids``.

    ``crc32`` is over the ids as little-endian unsigned 32-bit integers, ``start`` the number of ids in all
    documents before. With ``doc_id`` only the blocks that can hold it are read and only its frames opened. A
    block written under another dictionary than the store's fails the read.
    """
    tune(spark)
    dict_hash, dictionary, width = _dictionary(spark, folder)
    blocks = spark.read.parquet(f"{folder}/blocks").withColumnRenamed("before", "in_shard")
    if doc_id is not None:
        blocks = blocks.filter((F.col("first_id").isNull() | (F.col("first_id") <= doc_id)) & (F.col("last_id") >= doc_id))
    shards = spark.read.parquet(f"{folder}/shards")
    rows = blocks.join(shards, "shard").select((F.col("start") + F.col("in_shard")).alias("start"), "dict_hash", "doc_ids", "offsets", "counts", "payload")
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)

    def open_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        for batch in batches:
            for start, have, keys, offsets, counts, payload in zip(*(batch.column(i) for i in range(6))):
                if have.as_py() != dict_hash:
                    raise ValueError(f"a block needs the dictionary {have.as_py()}, the store has {dict_hash}")
                data = memoryview(payload.as_buffer())
                at = offsets.values.to_numpy()
                many = counts.values.to_numpy().astype(np.int64)
                starts = start.as_py() + np.concatenate([[0], np.cumsum(many)[:-1]])
                wanted = np.arange(len(many)) if doc_id is None else np.flatnonzero(np.array([x == doc_id for x in keys.as_py()]))
                ids = [np.frombuffer(press.decompress(data[at[i] : at[i + 1]], max_output_size=int(many[i]) * width), f"<u{width}").astype("<u4") for i in wanted]
                if any(len(x) != many[i] for x, i in zip(ids, wanted)):
                    raise ValueError("a document's frame does not hold as many ids as its index says")
                columns = [keys.values.take(pa.array(wanted)), pa.array(starts[wanted]), pa.array(many[wanted]), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if with_ids:
                    columns.append(pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(open_blocks, schema)
