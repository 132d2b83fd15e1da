"""Exact top-k by inner product, with bounds from segment means and deviations.

Cut two vectors alike into segments: the product of a segment is (length x mean x mean) plus the product of
what the means leave over, and that is at most the product of the two leftover norms. Few segments bound
coarsely and cheaply, more bound finer; a pair is scored exactly only if no level rules it out. (For vectors
of given norms a lower bound on the distance is an upper bound on the product, and the other way round.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, hash_share, tune

K = 5
QUERY_BLOCK = 1024
BLOCK = 4096
#: Candidates whose exact scores give each query its first threshold; any subset gives a valid one.
SEEDS = 4096
#: So many bytes of query blocks are broadcast at a time; more are searched in several passes over the candidates.
MAX_BROADCAST = 24 << 20

_LEVELS = (1, 4, 16)
_ROWS = 256
_LONG = (1 << 63) - 1
#: Norms whose product is below these bounds have an inner product that a float or an integer of 64 bits holds exactly.
_FLOAT, _INTEGER = float(1 << 53), float(1 << 62)


@dataclass
class Block:
    """Vectors of one dimension as whole numbers, with their norms and segment statistics."""

    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    stats: list[np.ndarray]

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> Block:
        norms = vector_norms(vectors)
        return cls(ids, vectors, norms, [segment_stats(vectors, n, norms) for n in _LEVELS if n <= vectors.shape[1]])


def vector_norms(vectors: np.ndarray) -> np.ndarray:
    """Euclidean norms, a little too large, and finite for any finite vector."""
    values = vectors.astype(np.float64)
    most = np.abs(values).max(axis=1, initial=0)
    unit = values / np.where(most > 0, most, 1)[:, None]
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt((unit**2).sum(axis=1)) * (1 + 1e-9), np.finfo(np.float64).max)


def segment_stats(vectors: np.ndarray, segments: int, norms: np.ndarray) -> np.ndarray:
    """For each vector and segment the mean and the leftover norm, scaled so that their products add up to the bound.

    The last column is a share of the norm: its product is more than all rounding that the bound can suffer, which
    grows with both norms and the dimension and not with the score.
    """
    dim = vectors.shape[1]
    parts = np.array_split(np.arange(dim), segments)
    out = np.empty((len(vectors), 2 * segments + 1))
    with np.errstate(over="ignore", invalid="ignore"):
        for i, part in enumerate(parts):
            own = vectors[:, part].astype(np.float64)
            mean = own.mean(axis=1)
            out[:, i] = mean * np.sqrt(len(part))
            out[:, segments + i] = np.sqrt(((own - mean[:, None]) ** 2).sum(axis=1))
        out[:, -1] = norms * np.sqrt((dim + 32) * 2.0**-49)
    return out


def exact_scores(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Inner products of rows of whole numbers; ``size`` bounds them. What 64 bits do not hold is the nearest long."""
    out = np.empty(len(a), np.int64)
    low, wide = size < _FLOAT, size >= _INTEGER
    middle = ~low & ~wide
    with np.errstate(invalid="ignore"):
        out[low] = np.einsum("ij,ij->i", a[low].astype(np.float64), b[low].astype(np.float64)).astype(np.int64)
        out[middle] = np.einsum("ij,ij->i", a[middle].astype(np.int64), b[middle].astype(np.int64))
    for i in np.flatnonzero(wide):
        out[i] = max(-_LONG, min(_LONG, sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[i].tolist()))))
    return out


@dataclass
class Best:
    """The k best of each query so far: scores and ids, best first; empty places have the lowest score."""

    scores: np.ndarray
    ids: np.ndarray
    floor: np.ndarray

    @classmethod
    def empty(cls, many: int, k: int, floor: np.ndarray) -> Best:
        return cls(np.full((many, k), np.iinfo(np.int64).min), np.full((many, k), np.iinfo(np.int64).max), floor)

    def threshold(self) -> np.ndarray:
        """A score below which no candidate can be among a query's k best."""
        return np.maximum(self.floor, self.scores[:, -1])

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, at = np.unique(query, return_inverse=True)
        k = self.scores.shape[1]
        who = np.concatenate([at, np.repeat(np.arange(len(rows)), k)])
        score = np.concatenate([scores, self.scores[rows].ravel()])
        key = np.concatenate([ids, self.ids[rows].ravel()])
        # ~x orders like -x and has no overflow at the lowest score.
        order = np.lexsort((key, ~score, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order], side="left")
        order = order[place < k]
        self.scores[rows] = score[order].reshape(-1, k)
        self.ids[rows] = key[order].reshape(-1, k)


def search(queries: Block, candidates: Block, best: Best) -> int:
    """Add the candidates that can be among the queries' best; returns how many pairs were scored exactly."""
    scored = 0
    top = candidates.norms.max(initial=0)
    for a in range(0, len(queries.ids), _ROWS):
        part = slice(a, a + _ROWS)
        threshold = best.threshold()[part]
        limit = np.where(threshold > -_LONG, np.nextafter(threshold.astype(np.float64), -np.inf), -np.inf)
        columns = np.arange(len(candidates.ids))
        alive = queries.ids[part, None] != candidates.ids[None, :]
        for here, other in zip(queries.stats, candidates.stats):
            with np.errstate(over="ignore", invalid="ignore"):
                bound = here[part] @ other[columns].T
            alive &= ~(bound < limit[:, None])  # a bound that overflowed rules nothing out
            some = alive.any(axis=0)
            if not some.all():
                alive, columns = alive[:, some], columns[some]
        if not len(columns):
            continue
        row, col = np.nonzero(alive)
        own, norms = queries.vectors[part], queries.norms[part]
        if norms.max(initial=0) * top < _FLOAT and len(row) * 8 >= alive.size:
            score = (own.astype(np.float64) @ candidates.vectors[columns].astype(np.float64).T)[row, col].astype(np.int64)
        else:
            with np.errstate(over="ignore"):
                size = norms[row] * candidates.norms[columns[col]]
            score = exact_scores(own[row], candidates.vectors[columns[col]], size)
        scored += len(row)
        good = score >= threshold[row]
        if good.any():
            best.add(row[good] + a, candidates.ids[columns[col[good]]], score[good])
    return scored


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) in the smallest type that holds all; beyond the largest double it counts as that."""
    with np.errstate(over="ignore"):
        out = np.clip(np.floor(256 * values), -np.finfo(np.float64).max, np.finfo(np.float64).max)
    most = np.abs(out).max(initial=0)
    return out.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64 if most < _INTEGER else np.float64)


_PACKED = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("ids", T.BinaryType()), T.StructField("vectors", T.BinaryType())])


def _pack(most: int):
    """Rows of (id, v) to blocks of at most ``most`` vectors of one dimension."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, values = (np.concatenate(x) for x in zip(*held.pop(dim)))
            vectors = whole_numbers(values)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([vectors.dtype.str]), pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], names=_PACKED.names)

        for batch in batches:
            lists = batch.column(1)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(dims)):
                at = np.flatnonzero(dims == dim)
                values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for i in range(0, len(at), most):
                    part = values[i : i + most]
                    if sum(len(x) for x, _ in held.get(dim, [])) + len(part) > most:
                        yield out(dim)
                    held.setdefault(dim, []).append((ids[at[i : i + most]], part))
        for dim in list(held):
            yield out(dim)

    return emit


def _unpack(dim: int, kind: str, ids: bytes, vectors: bytes) -> Block:
    return Block.of(np.frombuffer(ids, np.int64), np.frombuffer(vectors, kind).reshape(-1, dim))


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = K,
    query_block: int = QUERY_BLOCK,
    block: int = BLOCK,
    seeds: int = SEEDS,
    max_broadcast: int = MAX_BROADCAST,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k best candidates of each query.

    Queries are the rows whose id is divisible by ``every``, candidates all rows with another id; vectors
    become ``floor(256 * x)``, and the score is their integer inner product. Ties go to the smaller id.

    Defined cases: rows with a null id, a null or empty vector, or a null or non-finite component take no
    part; a query meets candidates of its own dimension only; of rows that share a query's id the smallest
    vector is the query; candidates that share an id each count; a query without candidates has no row; a
    product beyond 64 bits counts as the nearest long; an empty table gives no rows. Other columns are not read.

    Vectors are packed into blocks. So many query blocks as ``max_broadcast`` bytes hold are broadcast to all
    candidate blocks, which stay where they are read; more queries are searched in further passes, each of which
    keeps its k best rows a query and task. A task holds one candidate block and the broadcast queries.
    """
    spark = vectors.sparkSession
    tune(spark)
    usable = _usable(vectors, id_col, vector_col)
    queries = usable.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    many = queries.count()
    blocks = max(1, -(-many // query_block))
    dealt = queries.repartitionById(blocks, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).sortWithinPartitions("id")

    total = usable.count()
    share = min(1.0, (2 * seeds + 1000) / max(1, total))
    first = usable.filter(hash_share("id") <= share).orderBy(hash_share("id"), "id", "v").limit(seeds).collect()
    seed_rows: dict[int, list] = {}
    for r in first:
        seed_rows.setdefault(len(r.v), []).append(r)
    seed_blocks = {d: Block.of(np.array([r.id for r in rows], np.int64), whole_numbers(np.array([r.v for r in rows], np.float64))) for d, rows in seed_rows.items()}

    floor_schema = T.StructType([T.StructField("qb", T.LongType()), *_PACKED.fields, T.StructField("floor", T.BinaryType())])

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = []
            for dim, kind, ids, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                own = _unpack(dim, kind, ids, data)
                best = Best.empty(len(own.ids), k, np.full(len(own.ids), -_LONG - 1))
                if dim in seed_blocks:
                    search(own, seed_blocks[dim], best)
                floors.append(best.scores[:, -1].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.binary())], names=floor_schema.names)

    packed = dealt.mapInArrow(_pack(query_block), _PACKED).select(F.monotonically_increasing_id().alias("qb"), "*")
    with_floors = checkpointed(packed.mapInArrow(thresholds, floor_schema).selectExpr("qb", "dim as q_dim", "kind as q_kind", "ids as q_ids", "vectors as q_vectors", "floor"))
    candidates = usable.mapInArrow(_pack(block), _PACKED)
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple[Block, Best]] = {}
        last: tuple[bytes, Block] | None = None
        for batch in batches:
            for dim, kind, ids, data, qb, q_kind, q_ids, q_data, floor in zip(*(batch.column(i) for i in range(9))):
                number = qb.as_py()
                if number not in state:
                    own = _unpack(dim.as_py(), q_kind.as_py(), q_ids.as_py(), q_data.as_py())
                    state[number] = own, Best.empty(len(own.ids), k, np.frombuffer(floor.as_py(), np.int64))
                raw = data.as_py()
                if last is None or last[0] != raw:
                    last = raw, _unpack(dim.as_py(), kind.as_py(), ids.as_py(), raw)
                search(state[number][0], last[1], state[number][1])
        for own, best in state.values():
            row, place = np.nonzero(best.ids != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[row]), pa.array(best.ids[row, place]), pa.array(best.scores[row, place])], names=result.names)

    def searched(part: DataFrame) -> DataFrame:
        pairs = candidates.join(F.broadcast(part), F.col("dim") == F.col("q_dim"))
        found = pairs.select("dim", "kind", "ids", "vectors", "qb", "q_kind", "q_ids", "q_vectors", "floor").mapInArrow(score, result)
        ranked = found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
        return ranked.filter(F.col("rank") <= k)

    # One row a query block: QUERY_BLOCK queries.
    sizes = with_floors.select("qb", (F.length("q_vectors") + 2 * F.length("q_ids") + 100).alias("bytes")).orderBy("qb").collect()
    passes: list[list[int]] = [[]]
    held = 0
    for qb, size in sizes:
        if passes[-1] and held + size > max_broadcast:
            passes.append([])
            held = 0
        passes[-1].append(qb)
        held += size
    if len(passes) == 1:
        return searched(with_floors)
    # Query blocks are numbered in order, so a pass is a range of them; each pass is kept before the next begins.
    done = [checkpointed(searched(with_floors.filter(F.col("qb").between(p[0], p[-1])))) for p in passes]
    return reduce(DataFrame.union, done)


#: DuckDB SQL for the rows of the query op2.
ORACLE_SQL = """
WITH usable AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
