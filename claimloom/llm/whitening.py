"""Whitening of embeddings with principal axes found by LOBPCG.

The covariance matrix is never formed: each round multiplies one block of directions by
it in one pass over the centred rows, and the Rayleigh-Ritz step works on the span of
the iterate, the residual and the previous direction block, which are small. The axes
count as found when the true residuals, from a product of their own, are certified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm._common import checkpoint, fresh, require

SCALE = 256
AXES = 4
#: Directions iterated beside the wanted ones: they carry what lies next in the spectrum.
GUARDS = 8
#: Residual norm in parts of the largest eigenvalue at which the rounds end, and the most that is certified.
TOLERANCE = 5e-14
CERTIFIED = 1e-10
ROUNDS = 300
#: Vectors that are multiplied at a time.
ROWS = 4_096
#: Vectors of a partition that every round reads, at most where there are more than cores.
PIECE = 16 * ROWS


def usable(docs: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and holds no null, NaN or infinite entry."""
    c = F.col(column)
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return docs.where(c.isNotNull() & ~bad)


def grid(column: str = "embedding", scale: int = SCALE):
    """Entries as longs: floor(scale * c)."""
    return F.transform(F.col(column), lambda v: F.floor(v.cast("double") * scale).cast("long"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    lengths = np.asarray(pa.compute.list_value_length(column))
    flat = np.asarray(column.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    at = 0
    for i, n in enumerate(lengths):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """The smallest integer type that holds the block."""
    for kind in (np.int8, np.int16, np.int32):
        if x.size == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of the columns as Python integers."""
    bound = int(max(abs(int(x.max())), abs(int(x.min())))) * len(x) if x.size else 0
    return x.sum(axis=0, dtype=np.int64).astype(object) if bound < 2**62 else x.astype(object).sum(axis=0)


@dataclass(frozen=True)
class Whitening:
    """What was fitted: n and the sums of the fit list, its axes (columns) with their eigenvalues, and the checks."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    residual: float
    rounds: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)


def blocks_of(x: DataFrame, width: int, rows: int = ROWS) -> DataFrame:
    """Distinct vectors (column x) as blocks of integers, in the narrowest type that holds each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                m = _narrow(_matrix(batch.column(0).slice(at, rows), width))
                yield pa.RecordBatch.from_pydict({"rows": [len(m)], "kind": [m.dtype.str], "body": [m.tobytes()]})

    return x.mapInArrow(pack, "rows long, kind string, body binary")


def pieces(vectors: int, cores: int, rows: int = PIECE) -> int:
    """Partitions for so many vectors: every pass is a job, so they follow the vectors and the cores, not the shuffle's partitions."""
    return max(cores, -(-vectors // rows))


def total(blocks: DataFrame, width: int, of: Callable[[np.ndarray], object], add: Callable):
    """`of` of every block, added up: within a partition first, then up a tree. There has to be a block."""

    def part(rows):
        some = None
        for r in rows:
            got = of(np.frombuffer(r["body"], np.dtype(r["kind"])).reshape(r["rows"], width))
            some = got if some is None else add(some, got)
        if some is not None:
            yield some

    return blocks.rdd.mapPartitions(part).treeReduce(add)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `block` adds to the orthonormal `against`; dependent directions go."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
        if not block.shape[1]:
            break
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, guards: int = GUARDS, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Leading eigenpairs of a symmetric positive semidefinite matrix given by its product with a block.

    Gives the `wanted` axes as columns, their eigenvalues (falling), the largest residual
    norm in parts of the largest eigenvalue, from a product of its own, and the rounds.
    Raises RuntimeError where that residual stays above CERTIFIED. A matrix of zeros gives
    zero eigenvalues.
    """
    size = min(width, wanted + guards)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    ax = product(x)
    p = ap = np.zeros((width, 0))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    stalled = 0
    for done in range(1, rounds + 1):
        small = x.T @ ax
        values, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        x, ax, values = x @ turn, ax @ turn, values[::-1]
        left = ax - x * values
        norm = np.linalg.norm(left, axis=0)
        top = max(float(values[0]), 0.0)
        worst = float(norm[:wanted].max() / top) if top > 0 else 0.0
        if best is None or worst < best[0]:
            stalled = 0 if best is None or worst < best[0] / 2 else stalled + 1
            best = (worst, x, values)
        else:
            stalled += 1
        if worst <= tolerance or (stalled >= 8 and best[0] <= CERTIFIED):
            break
        held = np.concatenate([x, p], axis=1)
        w = _orthonormal(left, held)
        if not w.shape[1]:
            break
        basis = np.concatenate([held, w], axis=1)
        images = np.concatenate([ax, ap, product(w)], axis=1)
        small = basis.T @ images
        _, turn = np.linalg.eigh((small + small.T) / 2)
        lead = turn[:, ::-1][:, :size]
        # the next direction block: what the new iterate takes from outside the old one, made orthonormal to the new
        outside = lead.copy()
        outside[:size] = 0.0
        step = _orthonormal(outside, lead)
        x, ax, p, ap = basis @ lead, images @ lead, basis @ step, images @ step
    _, x, _ = best
    x = np.linalg.qr(x)[0]
    small = x.T @ (ax := product(x))
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn, values = turn[:, ::-1], values[::-1]
    x, ax = x @ turn, ax @ turn
    top = max(float(values[0]), 0.0) if len(values) else 0.0
    residual = float(np.linalg.norm(ax - x * values, axis=0)[:wanted].max() / top) if top > 0 else 0.0
    if residual > CERTIFIED:
        raise RuntimeError(f"LOBPCG: residual {residual:.2e} after {done} rounds")
    return x[:, :wanted], np.maximum(values[:wanted], 0.0), residual, done


def fit(vectors: DataFrame, axes: int = AXES, guards: int = GUARDS) -> Whitening:
    """Fit on the distinct vectors of column `x` (arrays of long).

    Copies meet before the shuffle, so a vector that fills a third of the table is one row
    a task. The distinct vectors are written down as blocks of integers, and every pass
    reads those. Nothing but blocks of `axes` + `guards` directions reaches the driver.
    Vectors of unequal length end in zeros up to the longest; an empty table gives n = 0.
    """
    distinct = vectors.select("x").distinct()
    size = vectors.agg(F.max(F.size("x")).alias("width"), F.count("x").alias("n")).first()
    width = size["width"] or 0
    if not width:
        n = distinct.count()
        return Whitening(n, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0, 0)
    blocks = checkpoint(blocks_of(distinct.coalesce(pieces(size["n"], vectors.sparkSession.sparkContext.defaultParallelism)), width))
    n, sums = total(blocks, width, lambda m: (len(m), _exact_sum(m)), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    mean = np.array([int(s) / n for s in sums])

    def product(w: np.ndarray) -> np.ndarray:
        def of(m: np.ndarray) -> np.ndarray:
            c = m - mean
            return c.T @ (c @ w)

        return total(blocks, width, of, np.add) / n

    trace = total(blocks, width, lambda m: float(((m - mean) ** 2).sum()), lambda a, b: a + b) / n
    wanted = min(axes, width)
    found, values, residual, done = lobpcg(product, width, wanted, guards)
    kept = values > 1e-13 * trace
    whiten = found[:, kept] / np.sqrt(values[kept])

    def moments(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (m - mean) @ whiten
        return z.sum(axis=0), z.T @ z

    error = 0.0
    if kept.any():
        first, second = total(blocks, width, moments, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        error = float(np.abs(second / n - np.outer(first / n, first / n) - np.eye(int(kept.sum()))).max())
    return Whitening(n, tuple(int(s) for s in sums), found, np.where(kept, values, 0.0), trace, error, residual, done)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum over dimensions of (n * x - S)^2; null beyond a long."""
    if x.size == 0:
        return [0] * len(x)
    bound = n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(abs(int(s)) for s in sums)
    if bound * bound * x.shape[1] < 2**63:
        return ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - sums) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def whiten(docs: DataFrame, fitted: Whitening, column: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """Per usable row of `docs` and axis: `key`, component (from 1), n, deviation, whitened, explained, identity_error.

    An axis without variance has null `whitened` and explained 0 (null where there is no
    variance at all). Rows whose vector is null or holds null or non-finite entries give
    none; repeated rows repeat; an empty table gives an empty one. `deviation` is null
    where it exceeds a long. Other columns are left out, whatever their names.
    """
    require(docs, column, key)
    axes, n = fitted.axes.shape[1], fitted.n
    sums, mean = np.array(fitted.sums, object), fitted.mean
    root = np.sqrt(np.where(fitted.values > 0, fitted.values, np.nan))
    explained = [float(e / fitted.trace) if fitted.trace > 0 else None for e in fitted.values]
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    width = len(fitted.sums)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part.column(1), width)
                z = ((x - mean) @ fitted.axes) / root
                far = _deviation(x, n, sums)
                rows, size = len(x), len(x) * axes
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(rows), axes))), pa.array(np.tile(np.arange(1, axes + 1, dtype=np.int32), rows)), pa.array(np.full(size, n, np.int64)),
                    pa.array([v for v in far for _ in range(axes)], pa.int64()), pa.array(z.ravel(), from_pandas=True), pa.array(explained * rows, pa.float64()), pa.array(np.full(size, fitted.identity_error)),
                ], names=[f.name for f in schema])

    return usable(docs, column).select(key, grid(column, scale).alias(fresh(docs, "__x"))).mapInArrow(apply, schema)


def whiten_embeddings(docs: DataFrame, column: str = "embedding", key: str = "vec_id", axes: int = AXES) -> DataFrame:
    """Fit on the distinct grid vectors of all usable rows, then whiten every usable row; see `fit` and `whiten`."""
    require(docs, column, key)
    return whiten(docs, fit(usable(docs, column).select(grid(column).alias("x")), axes), column, key)
