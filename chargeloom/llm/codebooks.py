"""Vectors as short codes: parts of a vector as indices into codebooks that Lloyd rounds improve, skipping by bounds.

The entries of a codebook lie in groups (Yinyang k-means). Each part of a vector keeps the distance to its own entry
as an upper bound and, for each group, one lower bound on the distance to the group's other entries. When entries move,
the upper bound grows by its entry's step and a lower bound shrinks by the largest step in its group; only groups
whose lower bound does not exceed the upper one are looked at. All values are whole numbers, so distances are exact,
and ties go to the lower index; where doubles cannot hold them, entries near the least are compared as integers.

A round is one Spark job: it reads the rows with their bounds, writes them with new ones, and writes one row of sums a
task beside them, which a tree of tasks merges. The driver holds the codebooks alone.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import delete_folder
from .common import fresh_folder, tune, unused_name, written
from .vectors import LONG, by_length, exact_sums, merge_by_length, tree_merge, usable, whole

FACTOR, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: About so many entries share a lower bound.
GROUP = 16
#: Labels of up to so many rows of sums are broadcast; beyond, only those with more than this share of all rows are.
MAX_BROADCAST_LABELS = 500_000

_ROWS = 2048
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def grouped(entries: np.ndarray, size: int = GROUP, rounds: int = 5) -> np.ndarray:
    """The group of each entry, by a few rounds of k-means over the entries themselves."""
    many = max(1, len(entries) // size)
    points = entries.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, many).astype(int)]
    own = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        own = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(many)])
    return np.unique(own, return_inverse=True)[1]


@dataclass
class Book:
    """The entries of one part, their groups, and how far each moved in the last round."""

    entries: np.ndarray
    groups: np.ndarray
    steps: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.steps = np.zeros(len(self.entries))
        self.members = [np.flatnonzero(self.groups == g) for g in range(int(self.groups.max(initial=-1)) + 1)]
        self._measure()

    def _measure(self) -> None:
        self.values = self.entries.astype(np.float64)
        self.squares = (self.values**2).sum(axis=1)
        self.most = int(np.abs(self.entries).max(initial=0))

    def replace(self, counts: np.ndarray, sums: np.ndarray) -> None:
        """Entries as the componentwise floor of their parts' means; those without parts stay."""
        new = self.entries.copy()
        for i in np.flatnonzero(counts):
            new[i] = [s // int(counts[i]) for s in sums[i].tolist()]
        self.steps = np.sqrt(((new - self.entries).astype(np.float64) ** 2).sum(axis=1)) * _UP
        self.entries = new
        self._measure()

    def plain(self, x: np.ndarray) -> np.ndarray:
        """Rows whose squared distances, and all that they are made of, doubles hold exactly."""
        most = np.maximum(np.abs(x).max(axis=1, initial=0), self.most)
        return most < np.sqrt(2.0**50 / max(1, x.shape[1]))


@dataclass
class State:
    """For rows of one part: their entry, the upper bound, and a lower bound for each group."""

    code: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def squared(x: np.ndarray, entries: np.ndarray) -> list[int]:
    """Squared distances of rows to one entry each, as Python integers."""
    return [sum((a - b) ** 2 for a, b in zip(p, q)) for p, q in zip(x.tolist(), entries.tolist())]


def _all_entries(book: Book, x: np.ndarray) -> State:
    """Nearest entries of rows of plain values, looking at all entries."""
    v = x.astype(np.float64)
    d = (v**2).sum(axis=1)[:, None] - 2 * (v @ book.values.T) + book.squares[None]
    code = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, code]) * _UP
    d[rows, code] = np.inf
    lower = np.stack([np.sqrt(d[:, m].min(axis=1)) for m in book.members], axis=1) * _DOWN
    return State(code, upper, lower)


def _huge(book: Book, x: np.ndarray) -> State:
    """The same for values that doubles do not hold: entries near the least distance are compared as integers."""
    code, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros((len(x), len(book.members)))
    for i, row in enumerate(x):
        d = ((row[None] - book.entries).astype(np.float64) ** 2).sum(axis=1)
        near = np.flatnonzero(d <= d.min() * (1 + 1e-12))
        exact = squared(np.repeat(row[None], len(near), axis=0), book.entries[near])
        code[i] = near[min(range(len(near)), key=lambda j: (exact[j], near[j]))]
        upper[i] = np.sqrt(d[code[i]]) * _UP
        d[code[i]] = np.inf
        lower[i] = [np.sqrt(d[m].min()) * _DOWN for m in book.members]
    return State(code, upper, lower)


def _bounded(book: Book, x: np.ndarray, old: State) -> tuple[State, int]:
    """Nearest entries of rows of plain values from the bounds of the round before; and how many distances that took."""
    v = x.astype(np.float64)
    code = old.code.copy()
    moved = np.array([book.steps[m].max() for m in book.members])
    lower = (old.lower - moved[None]) * np.where(old.lower > moved[None], _DOWN, _UP)
    upper = (old.upper + book.steps[code]) * _UP
    looked = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
    scanned = len(looked)
    if not len(looked):
        return State(code, upper, lower), 0
    own = ((v[looked] - book.values[code[looked]]) ** 2).sum(axis=1)
    upper[looked] = np.sqrt(own) * _UP
    start, best = code[looked].copy(), own.copy()
    second = np.full((len(looked), len(book.members)), np.nan)
    for g, members in enumerate(book.members):
        here = np.flatnonzero(lower[looked, g] <= np.sqrt(best) * _UP)
        if not len(here):
            continue
        rows = looked[here]
        d = (v[rows] ** 2).sum(axis=1)[:, None] - 2 * (v[rows] @ book.values[members].T) + book.squares[members][None]
        scanned += d.size
        d[start[here][:, None] == members[None]] = np.inf
        at = d.argmin(axis=1)
        every = np.arange(len(here))
        least = d[every, at]
        d[every, at] = np.inf
        lower[rows, g] = np.sqrt(least) * _DOWN
        second[here, g] = np.sqrt(d.min(axis=1)) * _DOWN
        better = (least < best[here]) | ((least == best[here]) & (members[at] < code[rows]))
        code[rows[better]], best[here[better]] = members[at[better]], least[better]
    changed = np.flatnonzero(code[looked] != start)
    rows = looked[changed]
    # The entry that a row comes to no longer counts in its group's bound; the one that it leaves does.
    into, out = book.groups[code[rows]], book.groups[start[changed]]
    lower[rows, into] = second[changed, into]
    lower[rows, out] = np.minimum(lower[rows, out], np.sqrt(own[changed]) * _DOWN)
    upper[looked] = np.sqrt(best) * _UP
    return State(code, upper, lower), scanned


def assign(book: Book, x: np.ndarray, old: State | None) -> tuple[State, int]:
    """The nearest entry of each row, ties to the lower index, with bounds; and how many distances were looked at."""
    plain = book.plain(x)
    out = State(np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros((len(x), len(book.members))))
    scanned = 0
    for rows, huge in ((np.flatnonzero(plain), False), (np.flatnonzero(~plain), True)):
        for i in range(0, len(rows), _ROWS):
            at = rows[i : i + _ROWS]
            if huge or old is None:
                found, many = (_huge if huge else _all_entries)(book, x[at]), len(at) * len(book.entries)
            else:
                found, many = _bounded(book, x[at], State(old.code[at], old.upper[at], old.lower[at]))
            out.code[at], out.upper[at], out.lower[at] = found.code, found.upper, found.lower
            scanned += many
    return out, scanned


def errors(book: Book, x: np.ndarray, code: np.ndarray) -> list[int]:
    """Squared distances of rows to their entries."""
    plain = book.plain(x)
    fast = ((x[plain] - book.entries[code[plain]]) ** 2).sum(axis=1)
    out = np.zeros(len(x), object)
    out[plain] = fast.tolist()
    if not plain.all():
        out[~plain] = np.array(squared(x[~plain], book.entries[code[~plain]]), object)
    return out.tolist()


def sums(book: Book, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each entry has, and their exact componentwise sums."""
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=len(book.entries))
    total = np.zeros(book.entries.shape, object)
    for i, part in zip(np.flatnonzero(counts), np.split(x[order], np.cumsum(counts[counts > 0])[:-1])):
        total[i] = exact_sums(part)
    return counts.astype(object), total


def cuts(length: int, parts: int) -> list[slice]:
    """Consecutive parts of a vector, equal where the length allows, else as equal as it does."""
    ends = [p * length // parts for p in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


@dataclass
class Codebooks:
    """The books of every part, by vector length; ``scanned`` has the distances that each round looked at."""

    books: dict[int, list[Book]]
    parts: int
    scanned: list[int] = field(default_factory=list)

    def digest(self, length: int) -> str:
        """SHA-256 of all entries' components by part, entry and position, in decimals joined by commas."""
        numbers = (str(x) for b in self.books[length] for x in b.entries.ravel().tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def first_books(rows: DataFrame, id_col: str, parts: int, entries: int, size: int) -> dict[int, list[Book]]:
    """For each vector length books of the parts of the vectors with the smallest ids (none counts as the largest)."""
    out = {}
    for (length,) in rows.select(F.size("x")).distinct().collect():
        first = rows.filter(F.size("x") == length).orderBy(F.col(f"row.{id_col}").isNull(), f"row.{id_col}", "x").limit(entries)
        found = [r.x for r in first.select("x").collect()]
        x = np.array(found, np.int64).reshape(len(found), length)
        out[length] = [Book(x[:, c], grouped(x[:, c], size)) for c in cuts(length, parts)]
    return out


def _packed(states: list[State]) -> list[list[bytes]]:
    """Codes and bounds of all parts of each row; bounds as floats, rounded to their own side."""
    with np.errstate(over="ignore"):
        code = np.stack([s.code for s in states], axis=1).astype(np.int32)
        upper = np.nextafter(np.stack([s.upper for s in states], axis=1).astype(np.float32), np.float32(np.inf))
        lower = np.nextafter(np.concatenate([s.lower for s in states], axis=1).astype(np.float32), np.float32(-np.inf))
    return [[r.tobytes() for r in x] for x in (code, upper, lower)]


def _unpacked(books: list[Book], code: pa.Array, upper: pa.Array, lower: pa.Array) -> list[State]:
    code, upper, lower = (np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), -1) for c, kind in ((code, np.int32), (upper, np.float32), (lower, np.float32)))
    ends = np.cumsum([0, *(len(b.members) for b in books)])
    return [State(code[:, p].astype(np.int64), upper[:, p].astype(np.float64), lower[:, a:b].astype(np.float64)) for p, (a, b) in enumerate(zip(ends, ends[1:]))]


def _floored(rows: DataFrame, vector_col: str) -> DataFrame:
    """``row`` (all other columns) and ``x`` (whole numbers) of the usable rows."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def numbers(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        flat = whole(column.flatten().to_numpy(zero_copy_only=False), FACTOR)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))

    others = [c for c in rows.columns if c != vector_col]
    kept = rows.filter(usable(F.col(vector_col)))
    return kept.select(F.struct(*others).alias("row"), numbers(F.col(vector_col).cast("array<double>")).alias("x"))


def compress(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    group: int = GROUP,
) -> tuple[DataFrame, Codebooks]:
    """The rows whose vector can be used, without it, with its ``length``, ``code`` (an index for each part) and ``error``; and the codebooks.

    A component counts as floor(1024 * x). Codebooks start as the parts of the ``entries`` rows with the smallest ids;
    each of ``rounds`` rounds assigns every part to its nearest entry and then replaces entries by the floor of
    their parts' means, entries without parts stay, and a last assignment gives the codes. ``error`` is the squared
    distance of the vector to its entries.

    Defined cases: rows whose vector is null, or holds a null or a number that is not finite, go. Ties go to the lower
    index, also between equal entries; rows that share an id are ordered by their vector, and rows without an id
    come last; repeated rows count each. Vectors of each length have codebooks of their own, of fewer entries
    where there are fewer rows; a length that ``parts`` does not divide is cut as evenly as it allows, and parts
    without components have code 0. Scaled components beyond 2^61 and errors beyond a long count as that bound. An
    empty table gives no rows. Columns named ``length``, ``code`` or ``error`` are replaced, others stay.
    """
    spark = vectors.sparkSession
    tune(spark)
    source = _floored(vectors.select(*(F.col(c) for c in vectors.columns)), vector_col)
    known = Codebooks(first_books(source, id_col, parts, entries, group), parts)
    fields = [T.StructField("row", source.schema["row"].dataType), T.StructField("x", T.ArrayType(T.LongType()))]
    state = [T.StructField(n, T.BinaryType()) for n in ("code", "upper", "lower")]
    kept = T.StructType([*fields, *state, T.StructField("sums", T.BinaryType())])
    final = T.StructType([fields[0], T.StructField("length", T.IntegerType()), T.StructField("code", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])

    def add(a, b):
        return a[0] + b[0], [(n + m, s + t) for (n, s), (m, t) in zip(a[1], b[1])]

    both = merge_by_length(add)

    def emit(books, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            for batch in batches:
                for length, at, x in by_length(batch.column(1)):
                    own, where = books.value[length], cuts(length, parts)
                    rows = batch.take(pa.array(at)) if len(at) < len(batch) else batch
                    old = _unpacked(own, *rows.columns[2:5]) if rows.num_columns > 2 else [None] * parts
                    found = [assign(b, x[:, c], o) for b, c, o in zip(own, where, old)]
                    if last:
                        each = [errors(b, x[:, c], s.code) for b, c, (s, _) in zip(own, where, found)]
                        total = [min(LONG, sum(e)) for e in zip(*each)]
                        codes = np.stack([s.code for s, _ in found], axis=1).astype(np.int32).tolist()
                        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([length] * len(x), pa.int32()), pa.array(codes, pa.list_(pa.int32())), pa.array(total, pa.int64())], names=final.names)
                        continue
                    held = both(held, {length: (sum(n for _, n in found), [sums(b, x[:, c], s.code) for b, c, (s, _) in zip(own, where, found)])})
                    columns = [pa.array(c, pa.binary()) for c in _packed([s for s, _ in found])]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:2], *columns, pa.nulls(len(x), pa.binary())], names=kept.names)
            if held:
                kinds = [batch.schema.field(0).type, batch.schema.field(1).type, *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([pickle.dumps(held)], pa.binary())], names=kept.names)

        return run

    rows, before = source, None
    for _ in range(rounds):
        books = spark.sparkContext.broadcast(known.books)
        folder = fresh_folder(spark, "codes")
        table = written(rows.mapInArrow(emit(books, False), kept), folder)
        found = tree_merge(table.filter("sums is not null").select("sums"), both) or {}
        known.scanned.append(sum(n for n, _ in found.values()))
        for length, (_, totals) in found.items():
            for book, (counts, total) in zip(known.books[length], totals):
                book.replace(counts, total)
        rows = table.filter("sums is null").drop("sums")
        books.unpersist()
        if before is not None:
            delete_folder(spark, before)
        before = folder
    books = spark.sparkContext.broadcast(known.books)
    coded = written(rows.mapInArrow(emit(books, True), final), fresh_folder(spark, "codes"))
    if before is not None:
        delete_folder(spark, before)
    others = [c for c in vectors.columns if c != vector_col and c.lower() not in ("length", "code", "error")]
    return coded.select(*(F.col(f"row.`{c}`").alias(c) for c in others), "length", "code", "error"), known


def with_label_error(coded: DataFrame, label_col: str = "label", most: int = MAX_BROADCAST_LABELS) -> DataFrame:
    """``coded`` with ``label_error``: the sum of ``error`` over the rows of the same label, null being one label.

    Sums are partial before they are shuffled. Up to ``most`` labels are broadcast back to the rows. Of more, those
    that hold over one in ``most`` of the rows are (fewer than ``most``), and the rows of the others are joined by label.
    A sum beyond a long counts as the largest long.
    """
    name = unused_name("label", coded)
    bound = F.lit(LONG).cast("decimal(38,0)")
    totals = coded.groupBy(F.col(label_col).alias(name)).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), bound).cast("long").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    totals = written(totals, fresh_folder(coded.sparkSession, "labels"))
    labels, rows = totals.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    same = F.col(label_col).eqNullSafe(F.col(name))
    coded = coded.drop("label_error")
    if labels <= most:
        return coded.join(F.broadcast(totals.drop("_rows")), same).drop(name)
    hot = totals.filter(F.col("_rows") > rows / most).drop("_rows")
    marked = coded.join(F.broadcast(hot), same, "left")
    cold = marked.filter(F.col("label_error").isNull()).drop(name, "label_error").join(totals.filter(F.col("_rows") <= rows / most).drop("_rows"), same)
    return marked.filter(F.col("label_error").isNotNull()).drop(name).unionByName(cold.drop(name))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the rows of the query op11: every round is spelt out, and every part meets every entry."""
    nearest = "SELECT p.vec_id, p.part, p.v, arg_min(b.entry, struct_pack(d := {d}, e := b.entry)) AS entry, min({d}) AS d FROM pieces p JOIN {book} b ON b.part = p.part GROUP BY ALL"
    distance = "list_sum(list_transform(list_zip(p.v, b.v), lambda z: CAST((z[1] - z[2]) * (z[1] - z[2]) AS BIGINT)))"
    steps = []
    for r in range(rounds):
        steps.append(f"assigned{r} AS MATERIALIZED ({nearest.format(d=distance, book=f'book{r}')})")
        means = f"SELECT part, entry, list(CAST(floor(total / CAST(n AS DOUBLE)) AS BIGINT) ORDER BY i) AS v FROM (SELECT part, entry, i, sum(v[i]) AS total, count(*) AS n FROM assigned{r}, range(1, 1000) AS places(i) WHERE i <= len(v) GROUP BY ALL) GROUP BY ALL"
        steps.append(f"book{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN ({means}) m USING (part, entry))")
    steps.append(f"coded AS MATERIALIZED ({nearest.format(d=distance, book=f'book{rounds}')})")
    return f"""
WITH usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
    SELECT vec_id, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS v FROM usable, range({parts}) AS r(part)
), book0 AS MATERIALIZED (
    SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM pieces) WHERE entry < {entries}
), {", ".join(steps)}, whole AS (
    SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM coded GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM whole JOIN usable USING (vec_id), digest
"""
