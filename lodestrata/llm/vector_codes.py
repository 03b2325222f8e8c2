"""Vector codes: integer product quantisation whose nearest entries are found through a VA file.

Vectors become integers and are cut into equal parts, each with a codebook of its own. A codebook's entries are
quantised to a few bits a coordinate, its *cells*. For each query a table per coordinate gives the least and the
greatest squared difference to each cell; sums of looked-up values bound the distance to every entry from below and
above. Only entries whose lower bound reaches the least upper bound are refined, by exact integer distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import durable, joined_hot

#: Parts of a vector, entries of a part's codebook (two hex digits each), rounds of training, integer steps of 1.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a coordinate's cell.
BITS = 4
#: Parts of vectors that are looked up in one step.
STEP = 1024
#: Sums leave a task in digits of this base, so they are exact whatever their size.
BASE = 1 << 60


class Cells:
    """The VA file of one codebook (entries x coordinates, integers)."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        n, self.entries = len(entries), entries
        order = np.argsort(entries, axis=0, kind="stable")
        cells = min(1 << bits, n)
        of_rank = np.arange(n) * cells // n
        self.code = np.empty(entries.shape, dtype=np.int64)
        np.put_along_axis(self.code, order, np.broadcast_to(of_rank[:, None], entries.shape), axis=0)
        ranked, first = np.take_along_axis(entries, order, axis=0), np.searchsorted(of_rank, np.arange(cells))
        self.low, self.high = ranked[first], ranked[np.append(first[1:], n) - 1]

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each entry (rows) to each query (columns)."""
        lower = np.zeros((len(self.entries), len(queries)), dtype=queries.dtype)
        upper = lower.copy()
        for i in range(queries.shape[1]):
            below, above = self.low[:, i, None] - queries[None, :, i], queries[None, :, i] - self.high[:, i, None]
            lower += (np.maximum(np.maximum(below, above), 0) ** 2)[self.code[:, i]]
            upper += (np.maximum(abs(below), abs(above)) ** 2)[self.code[:, i]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query, the lower of equals, and its squared distance."""
        lower, upper = self.bounds(queries)
        query, entry = np.nonzero((lower <= upper.min(axis=0)).T)
        distance = ((queries[query] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.searchsorted(query, np.arange(len(queries)))
        least = np.minimum.reduceat(distance, first)
        hit = np.flatnonzero(distance == least[query])
        return entry[hit[np.searchsorted(query[hit], np.arange(len(queries)))]], least


def integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of finite numbers: 64-bit integers, or Python's where those would not do for sums of squares."""
    peak = float(np.abs(values).max(initial=0.0))
    if peak * scale < 2**26:
        return np.floor(values * scale).astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(values.shape)


@dataclass(frozen=True)
class Codebooks:
    """``entries``: parts x entries x coordinates as nested lists of integers; ``width``: components of a vector, padding included."""

    entries: list[list[list[int]]]
    width: int

    @cached_property
    def cells(self) -> list[Cells]:
        return [Cells(_array(e)) for e in self.entries]

    def joined(self) -> str:
        """All components in decimal by part, entry and position, with commas between."""
        return ",".join(str(x) for part in self.entries for entry in part for x in entry)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry indexes (vectors x parts) and squared distances (the same shape) of integer vectors."""
        size, codes, errors = self.width // len(self.entries), [], []
        for k, cells in enumerate(self.cells):
            own = vectors[:, k * size : (k + 1) * size]
            wide = own.dtype == object or cells.entries.dtype == object or size >= 1 << 8
            found = [_exact(cells, own[a : a + STEP], wide) for a in range(0, len(own), STEP)]
            codes.append(np.concatenate([c for c, _ in found]))
            errors.append(np.concatenate([e for _, e in found]))
        return np.stack(codes, axis=1), np.stack(errors, axis=1)


def _array(rows: list[list[int]]) -> np.ndarray:
    peak = max((abs(x) for row in rows for x in row), default=0)
    return np.array(rows, dtype=np.int64 if peak < 2**26 else object).reshape(len(rows), -1)


def _exact(cells: Cells, queries: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """``cells.nearest`` in integers of any size if ``wide``."""
    return Cells(cells.entries.astype(object)).nearest(queries.astype(object)) if wide else cells.nearest(queries)


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, x`` (double components) of the vectors that are not null and have finite components only."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    return rows.where(F.col("x").isNotNull() & F.forall("x", lambda x: F.coalesce(finite(x), F.lit(False))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as double vectors, padded with zeros."""
    column = column.cast(pa.large_list(pa.float64()))
    ends = np.asarray(column.offsets, dtype=np.int64)
    flat = np.asarray(column.values)[ends[0] : ends[-1]]
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _steps(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, (8 << 20) // (8 * max(width, 1)))
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, integers(_matrix(part.column("x"), width))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of ``kept`` rows: started from the vectors of the smallest ids, then ``rounds`` of assignment and floored means.

    Each round is a pass over the vectors. A task sends one row for each part and entry, so neither the driver nor
    any shuffle sees more than parts x entries rows a task; the driver gets their sums.
    """
    longest = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    width = -(-longest // parts) * parts
    size = width // parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow().column("x").combine_chunks()
    start = integers(_matrix(first, width)).tolist() if len(first) else []
    books = Codebooks([[v[k * size : (k + 1) * size] for v in start] for k in range(parts)], width)
    if not start or not width:
        return books
    vectors = rows.select("x")
    for _ in range(rounds):
        sums = vectors.mapInArrow(_summed(books), "part int, entry int, digit int, sums array<long>, n long").groupBy("part", "entry", "digit")
        total = sums.agg(F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size)]).alias("sums"), F.sum("n").alias("n")).collect()
        made: dict[tuple[int, int], tuple[list[int], int]] = {}
        for r in total:
            old, n = made.get((r.part, r.entry), ([0] * size, 0))
            made[r.part, r.entry] = ([a + int(b) * BASE**r.digit for a, b in zip(old, r.sums, strict=True)], n + r.n)
        entry = lambda k, j, old, made=made: [s // made[k, j][1] for s in made[k, j][0]] if (k, j) in made else old
        books = Codebooks([[entry(k, j, old) for j, old in enumerate(book)] for k, book in enumerate(books.entries)], width)
    return books


def _summed(books: Codebooks):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, size = len(books.entries), len(books.entries[0]), books.width // len(books.entries)
        sums, n = np.zeros((parts, entries, size), dtype=object), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for _, vectors in _steps(batch, books.width):
                codes, _ = books.nearest(vectors)
                for k in range(parts):
                    own = np.zeros((entries, size), dtype=vectors.dtype)
                    np.add.at(own, codes[:, k], vectors[:, k * size : (k + 1) * size])
                    sums[k] += own
                    n[k] += np.bincount(codes[:, k], minlength=entries)
        rows = []
        for k, j in zip(*np.nonzero(n), strict=True):
            left, digit = sums[k, j].tolist(), 0
            while True:
                low = [x if -BASE < x < BASE else x % BASE for x in left]
                rows.append((int(k), int(j), digit, low, int(n[k, j]) if digit == 0 else 0))
                left = [(x - a) // BASE for x, a in zip(left, low, strict=True)]
                if not any(left):
                    break
                digit += 1
        kind = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("digit", pa.int32()), ("sums", pa.list_(pa.int64())), ("n", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, kind, strict=True)], schema=kind)

    return run


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of ``kept`` rows; ``error`` is null beyond 64 bits. A pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, vectors in _steps(batch, books.width):
                codes, errors = books.nearest(vectors)
                whole = [e if e < 1 << 63 else None for e in errors.astype(object).sum(axis=1).tolist()]
                text = [bytes(row).hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array(text, pa.string()), pa.array(whole, pa.int64())], names=["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(code: Column, books: Codebooks) -> Column:
    """The integer vector that a code stands for: its parts' entries, one after the other. Null code: null."""
    table = F.array(*[F.array(*[F.array(*[F.lit(x) for x in entry]) for entry in part]) for part in books.entries])
    index = lambda k: F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int")
    return F.when(code.isNotNull(), F.concat(*[table[k][index(k)] for k in range(len(books.entries))]))


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error`` of every vector, written to the shared folder, and the codebooks.

    Rows whose vector is null or holds a null or a component that is not finite are left out. An empty vector has only zeros.
    A vector shorter than the longest, or whose length four does not divide, is padded with zeros. A null id comes after all
    others when the codebooks are started; equal ids go by their vectors; repeated rows count again. With fewer than 256
    vectors the codebooks are smaller; without any they are empty and so is the result. A null label is a label. Components of
    any finite size are exact. Other columns are ignored.
    """
    rows = kept(vectors, vec_id, embedding, label)
    books = train(rows)
    return durable(encode(rows, books)), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """Durable rows of ``encode`` with ``label_error``: the errors of all vectors of the label together, null labels being one."""
    rows = coded.withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    sums = durable(rows.groupBy("of").agg(F.count("*").alias("n"), F.sum("error").alias("label_error")))
    return joined_hot(rows, sums, "of").drop("of")
