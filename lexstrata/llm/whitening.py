"""Whitening of embeddings on exact integer moments, by products of digit slices.

Entries become integers x = floor(64 * c) + 1000000.  Sums and products are
exact: integers are split into limbs of LIMB_BITS signed bits, so that a
float64 BLAS product of two limb matrices of at most ROWS rows has no rounding
(2 ** (2 * LIMB_BITS - 2) * ROWS <= 2 ** 53), the products of limbs are put
together as big integers, and these are merged over tasks in any order.

Three passes over the rows: counts and sums; products of y = x - m, m being the
sums' rounded means, from which n * n * covariance = n * sum(y y') - r r' with
r = S - n * m follows exactly; and the projection on the covariance's unit
eigenvectors, which is stored.  A task gives one row of partial results; they
meet in MERGE groups of tasks and then in one, and the driver gets one row of
dimensions squared.  ``identity_error`` comes from the projected rows: means and
centred products of each batch, merged by their counts.

Cases: a vector that is null or empty, or has null or non-finite entries, is
left out; so is one whose length isn't the most frequent (ties: the longest), as
it has no place in the matrix.  Beyond the range of a 64-bit integer an entry is the
range's end.  Rows are independent of vec_id, so null or repeated ids
and repeated vectors each have their rows.  A component without variance (n = 1,
or dimensions that depend on others) has explained 0 and whitened 0, as it can't
be scaled, and doesn't count in identity_error.  A deviation beyond a long is
null; ``deviation_exact`` has its digits at any size.  Other columns are ignored; the
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexstrata.llm.memory import tidy
from lexstrata.llm.shared import stored

SCALE, SHIFT = 64, 1_000_000
LIMB_BITS = 16
ROWS = 1 << 12  # of a product, and of a batch
MERGE = 32
COMPONENTS = 32
LONG = (-(1 << 63), (1 << 63) - 1)
RESULT = "vec_id long, component int, n long, deviation long, deviation_exact string, whitened double, explained double, identity_error double"


def integers(entries: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 as int64, at the ends of its range beyond them."""
    scaled = np.floor(entries * float(SCALE))
    inside = np.abs(scaled) < 2.0**62
    x = np.where(inside, scaled, 0).astype(np.int64) + SHIFT
    if not inside.all():
        for at in zip(*np.nonzero(~inside), strict=True):
            exact = SCALE * int(entries[at]) if np.isfinite(scaled[at]) else (1 << 64) * (1 if entries[at] > 0 else -1)
            x[at] = min(max(exact + SHIFT, LONG[0]), LONG[1])
    return x


def limbs(values: np.ndarray, bits: int = LIMB_BITS) -> list[np.ndarray]:
    """Signed digits, least first, as float64; their sum weighted by 2 ** (bits * k) is the values."""
    out, half, base = [], 1 << (bits - 1), 1 << bits
    rest = values
    while True:
        digit = ((rest + half) & (base - 1)) - half if rest.dtype == object or np.abs(rest).max(initial=0) < 1 << 62 else None
        if digit is None:
            rest = rest.astype(object)
            continue
        out.append(digit.astype(np.float64))
        rest = (rest - digit) >> bits
        if not rest.any():
            return out


def exact_product(values: np.ndarray) -> np.ndarray:
    """values' * values as big integers, for at most ROWS rows of integers."""
    parts = limbs(values)
    total = np.zeros((values.shape[1], values.shape[1]), dtype=object)
    for i, a in enumerate(parts):
        for j, b in enumerate(parts[i:], i):
            product = (a.T @ b).astype(np.int64).astype(object)
            total += (product if i == j else product + product.T) << (LIMB_BITS * (i + j))
    return total


def vectors(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and entries, in parts of at most ROWS rows; rows are valid and dims long."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        flat = pc.list_flatten(part.column("entries")).to_numpy(zero_copy_only=False)
        yield part.column("vec_id"), flat.reshape(part.num_rows, dims)


def _valid(embeddings: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Ids and entries, as doubles, of rows whose vector is whole and finite."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists("entries", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return embeddings.select(F.col(id_column).cast("long").alias("vec_id"), entries.alias("entries")).where(F.col("entries").isNotNull() & (F.size("entries") > 0)).where(~bad)


def _merged(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], list[int]], spark: SparkSession) -> list[int] | None:
    """Sum over all tasks of the big integers that a task makes of its batches; None without rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = partial(batches)
        if total:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task % MERGE], pa.int32()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], ["bucket", "total"])

    def added(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in tables:
            for row in t.column("total"):
                v = np.array([int(x) for x in row.as_py()], dtype=object)
                total = v if total is None else total + v
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], ["bucket", "total"])

    schema = "bucket int, total array<string>"
    by_task = rows.mapInArrow(tidy(each), schema)
    sums = by_task.groupBy("bucket").applyInArrow(added, schema).groupBy("bucket").applyInArrow(added, schema).collect()
    return [int(v) for v in sums[0].total] if sums else None


@dataclass(frozen=True)
class Model:
    """What whitening needs of the fit list: all of it is of the size of dims squared."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray  # dims x k, unit columns
    eigenvalues: np.ndarray  # k, falling
    explained: np.ndarray  # k

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), or 0 where e is nothing but rounding."""
        least = max(self.eigenvalues.max(initial=0.0), 0.0) * 1e-13 * self.dims
        return np.where(self.eigenvalues > least, 1 / np.sqrt(np.where(self.eigenvalues > least, self.eigenvalues, 1)), 0.0)


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    def partial(batches: Iterator[pa.RecordBatch]) -> list[int]:
        n, total = 0, np.zeros(dims, dtype=object)
        for batch in batches:
            for _, entries in vectors(batch, dims):
                x = integers(entries)
                n += len(x)
                total += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        return [n, *total] if n else []

    n, *sums = _merged(rows, partial, rows.sparkSession)
    return n, sums


def covariance(n: int, sums: list[int], means: list[int], products: list[int]) -> np.ndarray:
    """From exact sums of products of x - means, each entry rounded once."""
    d = len(sums)
    r = [s - n * m for s, m in zip(sums, means, strict=True)]
    return np.array([[(n * products[i * d + j] - r[i] * r[j]) / (n * n) for j in range(d)] for i in range(d)])


def fit(rows: DataFrame, dims: int, components: int = COMPONENTS) -> Model:
    n, sums = _sums(rows, dims)
    means = [(2 * s + n) // (2 * n) for s in sums]

    def partial(batches: Iterator[pa.RecordBatch]) -> list[int]:
        total = None
        centre = np.array(means, dtype=object)
        small = all(abs(m) < 1 << 61 for m in means)
        for batch in batches:
            for _, entries in vectors(batch, dims):
                x = integers(entries)
                y = x - centre.astype(np.int64) if small and np.abs(x).max() < 1 << 61 else x.astype(object) - centre
                product = exact_product(y)
                total = product if total is None else total + product
        return [] if total is None else list(total.ravel())

    v = covariance(n, sums, means, _merged(rows, partial, rows.sparkSession))
    values, columns = np.linalg.eigh(v)
    order = np.argsort(values, kind="stable")[::-1][:components]
    trace = float(np.trace(v))
    values = np.maximum(values[order], 0.0)
    return Model(n, tuple(sums), columns[:, order], values, values / trace if trace > 0 else np.zeros(len(order)))


def projector(model: Model) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For a matrix of x: whitened rows, and n * x - S exactly, squared and summed over dimensions."""
    n, dims = model.n, model.dims
    means = [(2 * s + n) // (2 * n) for s in model.sums]
    rest = [s - n * m for s, m in zip(model.sums, means, strict=True)]
    shift = np.array([r / n for r in rest])
    basis = model.components * model.scales
    centre, exact_rest = np.array(means, dtype=object), np.array(rest, dtype=object)
    small = all(abs(m) < 1 << 61 for m in means)

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - centre.astype(np.int64) if small and np.abs(x).max() < 1 << 61 else x.astype(object) - centre
        most = max(abs(int(y.max())), abs(int(y.min())), 1)
        # n * x - S = n * y - rest, and rest is at most n / 2
        if y.dtype != object and dims * (n * (most + 1)) ** 2 < 1 << 63:
            d = n * y - exact_rest.astype(np.int64)
            deviation = (d * d).sum(axis=1)
        elif y.dtype != object and dims * (most + 1) ** 2 < 1 << 63 and dims * (most + 1) * n < 1 << 63:
            # n * n * sum(y * y) - 2 * n * sum(y * rest) + sum(rest * rest), the sums within 64 bits
            squares, mixed = (y * y).sum(axis=1).astype(object), (y * exact_rest.astype(np.int64)).sum(axis=1).astype(object)
            deviation = squares * (n * n) - mixed * (2 * n) + sum(r * r for r in rest)
        else:
            d = y.astype(object) * n - exact_rest
            deviation = (d * d).sum(axis=1)
        return (y.astype(np.float64) - shift) @ basis, deviation

    return project


def _projected(rows: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation, deviation_exact and the whitened array, stored."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = projector(shared.value)
        for batch in batches:
            for ids, entries in vectors(batch, shared.value.dims):
                w, deviation = project(integers(entries))
                exact = [int(v) for v in deviation]
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                longs = pa.array([v if v <= LONG[1] else None for v in exact], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, longs, pa.array([str(v) for v in exact]), whitened], ["vec_id", "deviation", "deviation_exact", "whitened"])

    return stored(rows.mapInArrow(tidy(run), "vec_id long, deviation long, deviation_exact string, whitened array<double>"), "whitened")


#: Count, mean and centred products of some rows.
Moments = tuple[int, np.ndarray, np.ndarray]


def merged_moments(a: Moments | None, b: Moments) -> Moments:
    """Of the rows of both."""
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def identity_error(projected: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(model.eigenvalues)
    kind = pa.list_(pa.float64())

    def packed(bucket: int, m: Moments) -> pa.RecordBatch:
        flat = [float(m[0]), *m[1], *m[2].ravel()]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([flat], kind)], ["bucket", "moments"])

    def unpacked(flat: list[float]) -> Moments:
        return int(flat[0]), np.array(flat[1 : k + 1]), np.array(flat[k + 1 :]).reshape(k, k)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = pc.list_flatten(batch.column(0).slice(at, ROWS)).to_numpy(zero_copy_only=False).reshape(-1, k)
                centred = w - w.mean(axis=0)
                total = merged_moments(total, (len(w), w.mean(axis=0), centred.T @ centred))
        if total is not None:
            yield packed(TaskContext.get().partitionId() % MERGE, total)

    def added(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for t in tables:
            for row in t.column("moments"):
                total = merged_moments(total, unpacked(row.as_py()))
        yield packed(key[0].as_py(), total)

    schema = "bucket int, moments array<double>"
    total = None
    for r in sorted(projected.select("whitened").mapInArrow(tidy(each), schema).groupBy("bucket").applyInArrow(added, schema).collect()):
        total = merged_moments(total, unpacked(r.moments))
    varies = model.scales > 0
    gap = np.abs(total[2] / total[0] - np.eye(k))[varies][:, varies]
    return float(gap.max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: RESULT."""
    spark = embeddings.sparkSession
    rows = _valid(embeddings, id_column, vector)
    lengths: list[Any] = rows.groupBy(F.size("entries").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    dims = lengths[0].d
    rows = rows.where(F.size("entries") == dims)
    model = fit(rows, dims, components)
    projected = _projected(rows, model)
    error = identity_error(projected, model)
    explained = F.array(*(F.lit(float(e)) for e in model.explained))
    out = projected.select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "deviation_exact",
        "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
