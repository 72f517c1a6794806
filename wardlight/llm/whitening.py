"""Whitening of embeddings by shifted CholeskyQR over distributed Gram passes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1024
OFFSET = 100_000
#: Scaled entries beyond this on either side count as this, so that all of them are exact doubles and longs.
MOST_ENTRY = 2.0**52
COMPONENTS = 8
#: Cholesky rounds at most; rows of full rank need three.
MOST_ROUNDS = 6
#: Rows turned at once inside a task.
BLOCK = 4096
#: Entries are summed in two halves, so that no sum of up to 2^37 rows leaves 64 bits.
LOW_BITS = 26
UNIT = float(np.finfo(np.float64).eps) / 2

Made = Callable[[np.ndarray], np.ndarray]


class Sums(NamedTuple):
    """The fit list: rows, per-dimension sums and the widest range of a dimension, all exact."""

    n: int
    sums: list[int]
    widest: int


class Whitener(NamedTuple):
    """Unit directions (a row each) by falling variance, their variances, and the variance of all dimensions."""

    of: Sums
    directions: np.ndarray
    variances: np.ndarray
    total: float


def whole_vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, vector array<double>) of the rows whose vector is there and holds finite entries only."""
    def bad(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    rows = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & ~F.exists("vector", bad))


def entries(column: pa.Array, width: int) -> np.ndarray:
    """x = floor(1024 c) + 100000 of each row's entries; places that a shorter vector lacks count as c = 0."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(flat * SCALE), -MOST_ENTRY, MOST_ENTRY).astype(np.int64) + OFFSET
    if (lengths == width).all():
        return scaled.reshape(-1, width)
    out = np.full((len(lengths), width), OFFSET, np.int64)
    first = np.cumsum(lengths) - lengths
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(first, lengths)] = scaled
    return out


def blocks(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, entries(part["vector"], width)


def exact_sums(rows: DataFrame, width: int) -> Sums:
    """One pass; a task sends one row a dimension."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        least, most = np.full(width, 2**62), np.full(width, -2**62)
        for _, x in blocks(batches, width):
            n += len(x)
            high += (x >> LOW_BITS).sum(0)
            low += (x & (2**LOW_BITS - 1)).sum(0)
            least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()),
                 *map(pa.array, (high, low, least, most))], ["i", "n", "high", "low", "least", "most"])

    made = rows.mapInArrow(run, "i int, n long, high long, low long, least long, most long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.min("least").alias("least"),
        F.max("most").alias("most")).collect()  # a row a dimension
    made.sort(key=lambda r: r["i"])
    return Sums(made[0]["n"] if made else 0, [(r["high"] << LOW_BITS) + r["low"] for r in made],
                max((r["most"] - r["least"] for r in made), default=0))


def deviations(x: np.ndarray, of: Sums) -> np.ndarray:
    """n * x - S, exact: 64-bit arithmetic wraps, but where the result itself fits it is right."""
    if of.n * of.widest < 2**62:
        sums = np.array([s % 2**64 for s in of.sums], np.uint64).view(np.int64)
        return x * np.int64(of.n) - sums
    return x.astype(object) * of.n - np.array(of.sums, object)


def deviation_of(u: np.ndarray) -> pa.Array:
    """The sum of squares of each row, exact; null where it passes 64 bits."""
    about = (u.astype(np.float64) ** 2).sum(1)
    if u.dtype == object:
        exact = [sum(int(v) ** 2 for v in row) for row in u]
    else:
        exact = (u * u).sum(1).tolist()  # wraps, but is right where the sum fits
        for i in np.flatnonzero(np.abs(about / 2.0**63 - 1) < 1e-6).tolist():
            exact[i] = sum(int(v) ** 2 for v in u[i])
    return pa.array([v if v < 2**63 and a < 2.0**63 * (1 + 1e-6) else None
                     for v, a in zip(exact, about.tolist(), strict=True)], pa.int64())


def solve_right(c: np.ndarray, r: np.ndarray) -> np.ndarray:
    """X with X r = c for an upper triangular r, a column after the other."""
    x = np.empty_like(c)
    for j in range(r.shape[1]):
        x[:, j] = (c[:, j] - x[:, :j] @ r[:j, j]) / r[j, j]
    return x


def gram(rows: DataFrame, width: int, made: Made, side: int) -> np.ndarray:
    """The sum of M^T M, M = ``made`` (entries of a block); a task sends one matrix, JVM sums them by cell."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((side, side)), False
        for _, x in blocks(batches, width):
            m = made(x)
            total += m.T @ m
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(side), pa.int32()), pa.array(list(total))], ["i", "line"])

    lines = rows.mapInArrow(run, "i int, line array<double>").select("i", F.posexplode("line").alias("j", "v"))
    out = np.zeros((side, side))
    for r in lines.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # the matrix, whatever the rows
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Principal directions of ``rows`` (key, vector) by shifted CholeskyQR.

    Each pass centres the rows exactly, turns them by the triangular factors so far and
    sums their Gram matrix.  The first factor is taken of the matrix plus a shift above
    its rounding error, so it exists for any rows; the next ones make the turned rows
    orthogonal.  Rows = Q R with R the product of the factors, so the singular values
    and right vectors of R are those of the rows: the covariance is never formed from
    large numbers, and its condition is never squared in the result.

    Directions without variance (fewer independent rows than ``components``) are left
    out.  What goes to the driver and back is a few width x width matrices.
    """
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    of = exact_sums(rows, width) if width else Sums(0, [], 0)
    none = Whitener(of, np.zeros((0, width)), np.zeros(0), 0.0)
    if not of.n:
        return none
    factors: list[np.ndarray] = []

    def turned(x: np.ndarray) -> np.ndarray:
        c = deviations(x, of).astype(np.float64) / of.n
        for r in factors:
            c = solve_right(c, r)
        return c

    whole = np.eye(width)
    for _ in range(MOST_ROUNDS):
        g = gram(rows, width, turned, width)
        values = np.linalg.eigvalsh(g)
        if values[-1] <= 0:
            return none  # all rows are equal
        # rows are summed by block, then by task: the error follows a block's rows, not all of them
        shift = 11 * (min(of.n, 256 * BLOCK) * width + width * (width + 1)) * UNIT * values[-1]
        least = 0.0 if factors and values[0] > 2 * shift else shift
        r = np.linalg.cholesky(g + least * np.eye(width)).T
        whole = r @ whole
        if np.abs(g - np.eye(width)).max() < 1e-8:
            break
        factors.append(r)
    sizes, right = np.linalg.svd(whole)[1:]
    kept = np.flatnonzero(sizes[:components] > 8 * width * UNIT * sizes[0])
    right = right[kept]
    sign = np.sign(right[np.arange(len(kept)), np.abs(right).argmax(1)])
    return Whitener(of, right * sign[:, None], sizes[kept] ** 2 / of.n, float((sizes**2).sum() / of.n))


def whitened(x: np.ndarray, by: Whitener) -> np.ndarray:
    return deviations(x, by.of).astype(np.float64) / by.of.n @ (by.directions.T / np.sqrt(by.variances))


def identity_error(rows: DataFrame, by: Whitener) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    side, width = len(by.variances), by.directions.shape[1]

    def with_one(x: np.ndarray) -> np.ndarray:
        return np.hstack([whitened(x, by), np.ones((len(x), 1))])

    g = gram(rows, width, with_one, side + 1) / by.of.n
    mean = g[:side, side]
    return float(np.abs(g[:side, :side] - np.outer(mean, mean) - np.eye(side)).max(initial=0))


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row per whole vector and component.

    Entries c become x = floor(1024 c) + 100000.  A vector that is null or holds a null,
    NaN or infinite entry is left out, other columns don't matter.  Repeated rows and
    null ids count like others.  A vector shorter than the longest counts as 0 in the
    places it lacks.  Scaled entries beyond 2^52 count as 2^52.  ``deviation`` is null
    where its exact value passes 64 bits.  No rows, empty vectors or equal rows only:
    there is no direction with variance, so the result is empty.
    """
    rows = whole_vectors(df, vector, key)
    by = fit(rows, components)
    error = identity_error(rows, by) if len(by.variances) else 0.0
    side, width = len(by.variances), by.directions.shape[1]
    explained = by.variances / by.total if side else by.variances
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not side:
            return
        for part, x in blocks(batches, width):
            row = np.repeat(np.arange(len(x)), side)
            many = len(row)
            yield pa.RecordBatch.from_arrays(
                [part["key"].take(pa.array(row)), pa.array(np.tile(np.arange(1, side + 1), len(x)), pa.int32()),
                 pa.array([by.of.n] * many, pa.int64()), deviation_of(deviations(x, by.of)).take(pa.array(row)),
                 pa.array(whitened(x, by).ravel()), pa.array(np.tile(explained, len(x))), pa.array([error] * many)],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")
