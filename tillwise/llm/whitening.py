"""Embedding whitening: bit-sliced scatter, integers centred before the eigenvectors.

Every entry c becomes the integer x = floor(64 c) + 1,000,000. Each task takes its vectors
some ten thousand at a time, subtracts the smallest x of each dimension and packs every bit
plane of every dimension across the rows into 64-bit words. The product of two dimensions is
the sum of 2^(p + q) times the number of ones in plane p of the one AND plane q of the
other: an exact integer, like the sums. The subtracted values are added back exactly, and
Spark adds up one number per pair of dimensions, whatever the number of rows. The driver
sees these D (D + 3) / 2 + 1 numbers, centres them as integers (n sum(xy) - sum(x) sum(y)),
divides once and takes the eigenvectors.

The whitened values are computed twice, first to measure how far their covariance over all
rows is from the identity, then as the result.

Defined cases: a vector that is null or empty, or that holds a null, a NaN, an infinity or an
entry of 2^56 or more (whose x is no long), is dropped. The width D is the commonest number of
entries (of equally common ones the largest); other vectors lack entries or have too many, and
are dropped too. Repeated rows each count, null vec_ids are values like others. A component
without variance (its eigenvalue is zero to double precision, as with fewer vectors than
dimensions) has whitened NULL and is left out of the identity error; explained is 0 where no
dimension varies. A deviation that does not fit a long is NULL. Very long vectors shrink the number of
rows packed at once, so memory stays bounded. An empty table gives no rows; columns other
than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.tables import Batches, map_batches, named

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Rows packed at once, and the most bits that the planes of a chunk may take.
CHUNK_ROWS, CHUNK_BITS = 65_536, 1 << 30
LARGEST_ENTRY = float(1 << 56)
LARGEST_LONG = (1 << 63) - 1
# The measured covariance is added up in units of 2^-30.
FIXED_POINT = 30

RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(c0, c1): the id and, as doubles, every vector whose entries are all finite numbers."""

    def finite(c: Column) -> Column:
        return F.coalesce((F.abs(c) < LARGEST_ENTRY) & ~F.isnan(c), F.lit(False))

    given = vectors.select(named(id_column).alias("c0"), named(vector_column).cast("array<double>").alias("c1"))
    return given.filter(F.coalesce((F.size("c1") > 0) & F.forall("c1", finite), F.lit(False)))


def commonest_width(given: DataFrame) -> int:
    widths = given.groupBy(F.size("c1").alias("width")).count().orderBy(F.desc("count"), F.desc("width"))
    first = widths.first()
    return first["width"] if first else 0


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The x of a batch of vectors, one row each."""
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.floor(entries * SCALE).astype(np.int64) + SHIFT


def planes(x: np.ndarray) -> np.ndarray:
    """Bit planes of non-negative numbers across the rows, as words: [dimension, plane, word]."""
    width = x.shape[1]
    bits = max(int(x.max()).bit_length(), 1)
    packed = np.empty((width, bits, -(-len(x) // 64)), np.uint64)
    filled = np.zeros((packed.shape[2] * 64, width), np.uint8)
    for p in range(bits):
        filled[: len(x)] = x >> p & 1
        packed[:, p] = np.packbits(filled, axis=0).T.copy().view(np.uint64)
    return packed


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and (upper triangle of) sums of products of the columns, as Python integers."""
    base = x.min(axis=0)
    shifted = x - base
    packed = planes(shifted)
    width, bits, words = packed.shape
    exact = np.int64 if 2 * bits + len(x).bit_length() < 62 else object
    weights = np.array([1 << p for p in range(2 * bits)], exact)
    sums = np.bitwise_count(packed).sum(axis=2, dtype=np.int64).astype(exact) @ weights[:bits]
    products = np.zeros((width, width), exact)
    for i in range(width):
        for p in range(bits):
            ones = np.bitwise_count(packed[i:] & packed[i, p]).sum(axis=2, dtype=np.int64).astype(exact)
            products[i, i:] += ones @ weights[p : p + bits]
    # Add back what was subtracted.
    sums, products, base, rows = sums.astype(object), products.astype(object), base.astype(object), len(x)
    products += np.outer(base, sums) + np.outer(sums, base) + rows * np.outer(base, base)
    return sums + rows * base, products


def _chunks(batches: Batches, width: int) -> Iterator[np.ndarray]:
    most = max(64, min(CHUNK_ROWS, CHUNK_BITS // (64 * width)))
    held, rows = [], 0
    for batch in batches:
        x = integers(batch.column(0), width)
        for first in range(0, len(x), most):
            held.append(x[first : first + most])
            rows += len(held[-1])
            if rows >= most:
                yield np.concatenate(held)
                held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def _totals(parts: DataFrame) -> list:
    """Sums of the parts (i, j, part) over all tasks; one row per pair (i, j)."""
    return parts.groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()


def _as_parts(values: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, part = zip(*values)
    columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in part], pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["i", "j", "part"])


PARTS = "i int, j int, part string"
NO_PAIR = -1


@dataclass(frozen=True)
class Whitening:
    """What is learned from the vectors: count, sums, and the components by falling eigenvalue."""

    width: int
    n: int
    sums: list[int]
    vectors: np.ndarray  # one column per component
    eigenvalues: np.ndarray
    explained: np.ndarray

    @property
    def varies(self) -> np.ndarray:
        return self.eigenvalues > 0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - floor(S / n), exact, and the n-ths that are still to be subtracted."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return x - whole, np.array([s % self.n for s in self.sums], np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of x projected on the components that vary, in units of their deviation."""
        near, rest = self.centred(x)
        varies = self.varies
        return (near - rest / self.n) @ self.vectors[:, varies] / np.sqrt(self.eigenvalues[varies])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exactly."""
        near, rest = self.centred(x)
        largest = (int(np.abs(near).max(initial=0)) + 1) * self.n
        exact = np.int64 if self.width * largest**2 <= LARGEST_LONG else object
        away = near.astype(exact) * self.n - rest.astype(exact)
        return [d if d <= LARGEST_LONG else None for d in (away * away).sum(axis=1).tolist()]


def components(n: int, sums: list[int], products: dict[tuple[int, int], int], most: int) -> Whitening:
    """The eigenvectors of the covariance; a direction is given the sign of its largest entry."""
    width = len(sums)
    covariance = np.empty((width, width))
    for (i, j), product in products.items():
        covariance[i, j] = covariance[j, i] = (n * product - sums[i] * sums[j]) / n**2
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(width)])
    values = np.where(values > width * np.finfo(float).eps * max(values[0], 0), values, 0.0)
    trace = np.trace(covariance)
    explained = values / trace if trace > 0 else np.zeros(width)
    return Whitening(width, n, sums, vectors[:, :most], values[:most], explained[:most])


def fit(given: DataFrame, width: int, most: int = COMPONENTS) -> Whitening:
    def count(batches: Batches) -> Batches:
        upper = [(i, j) for i in range(width) for j in range(i, width)]
        for x in _chunks(batches, width):
            sums, products = scatter(x)
            yield _as_parts(
                [
                    (NO_PAIR, NO_PAIR, len(x)),
                    *((i, NO_PAIR, sums[i]) for i in range(width)),
                    *((i, j, products[i, j]) for i, j in upper),
                ]
            )

    found = {(row.i, row.j): int(row.total) for row in _totals(map_batches(given.select("c1"), count, PARTS))}
    n, sums = found.pop((NO_PAIR, NO_PAIR)), [found.pop((i, NO_PAIR)) for i in range(width)]
    return components(n, sums, found, most)


def identity_error(given: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity."""
    size = int(fitted.varies.sum())

    def measure(batches: Batches) -> Batches:
        for x in _chunks(batches, fitted.width):
            y = fitted.whitened(x)
            products = np.rint((y.T @ y) * (1 << FIXED_POINT)).astype(np.int64)
            yield _as_parts([(i, j, products[i, j]) for i in range(size) for j in range(i, size)])

    if not size:
        return 0.0
    totals = _totals(map_batches(given.select("c1"), measure, PARTS))
    return max(abs(int(row.total) / (fitted.n << FIXED_POINT) - (row.i == row.j)) for row in totals)


def whiten(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    given = usable(vectors, id_column, vector_column)
    width = commonest_width(given)
    kind = given.schema["c0"].dataType.simpleString()
    if not width:
        return vectors.sparkSession.createDataFrame([], f"`{id_column}` {kind}, {RESULT}")
    given = given.filter(F.size("c1") == width)
    fitted = fit(given, width, most)
    error = identity_error(given, fitted)
    shown = len(fitted.eigenvalues)

    def result(batches: Batches) -> Batches:
        for batch in batches:
            x = integers(batch.column(1), width)
            rows, total = len(x), len(x) * shown
            whitened = np.zeros((rows, shown))
            whitened[:, fitted.varies] = fitted.whitened(x)
            each = pa.array(np.repeat(np.arange(rows), shown))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, shown + 1, dtype=np.int32), rows)),
                    pa.array(np.full(total, fitted.n)),
                    pa.array(fitted.deviations(x), pa.int64()).take(each),
                    pa.array(whitened.ravel(), mask=np.tile(~fitted.varies, rows)),
                    pa.array(np.tile(fitted.explained, rows)),
                    pa.array(np.full(total, error)),
                ],
                ["c0", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    found = map_batches(given, result, f"c0 {kind}, {RESULT}")
    return found.withColumnRenamed("c0", id_column)
