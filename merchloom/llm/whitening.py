"""Operator 13: whitening of embeddings by matrix-free block subspace iteration.

The covariance is never formed. Each pass over the rows computes Y = X'(XQ) on centred rows for a block Q of a few
columns: workers multiply Arrow batches, and Spark adds the products up by dimension. The driver holds matrices of
dimensions by block width: it takes QR of the block, Rayleigh-Ritz on Q'Y, and the residuals of the wanted components.
Passes go on until these certify all k components. Where residuals fall too slowly, as neighbouring eigenvalues are near,
the next block joins Y to Q and is twice as wide.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shared, arrow_batches

COMPONENTS = 4
#: Width of the first block: the components and some more that speed them up.
WIDTH = 12
#: Passes that a block of one width may still need; beyond, a wider one is quicker.
PATIENCE = 8
#: A residual of that share of the largest eigenvalue certifies a component; where rounding leaves more, one that no longer falls
#: does, if it is under LOOSE.
TIGHT, LOOSE = 1e-14, 1e-10
#: Eigenvalues under that share of the largest one count as zero: there is nothing to scale to one.
ZERO = 1e-12
BATCH = 10_000
LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of longs; shorter ones are filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    length = column.value_lengths().to_numpy(zero_copy_only=False)
    if (length == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(length), dim), np.int64)
    out[np.arange(dim) < length[:, None]] = flat
    return out


def _summed(fit: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of part(rows), a matrix of `width` columns: a row of it for each task and dimension is added up by Spark."""
    names = [f"c{j}" for j in range(width)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(_matrix(batch.column(0), dim))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), *[pa.array(total[:, j]) for j in range(width)]], ["i", *names])

    rows = fit.mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).orderBy("i").collect()
    return np.array([[r[c] for c in names] for r in rows])


@dataclass
class Whitening:
    """n and sums of the fit list, eigenvalues and unit eigenvectors (by column), the trace, and what the identity is missed by."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


def subspace_iteration(apply: Callable[[np.ndarray], np.ndarray], dim: int, k: int, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues and unit eigenvectors of a symmetric operator that apply(Q) multiplies with, and the passes made.

    At full width the Ritz vectors are the eigenvectors, so it ends for every spectrum.
    """
    k, width = min(k, dim), min(max(width, k), dim)
    block = np.linalg.qr(np.random.default_rng(13).standard_normal((dim, width)))[0]
    passes, before = 0, math.inf
    while True:
        image = apply(block)
        passes += 1
        small = block.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, moved = block @ turns, image @ turns
        scale = max(abs(values[0]), np.finfo(float).tiny)
        worst = float(np.max(np.linalg.norm(moved[:, :k] - ritz[:, :k] * values[:k], axis=0))) / scale
        if worst <= TIGHT or (worst <= LOOSE and worst > before / 2):
            return values[:k], ritz[:, :k] / np.linalg.norm(ritz[:, :k], axis=0), passes
        rate = worst / before
        slow = math.isfinite(before) and (rate >= 1 or math.log(TIGHT / worst) / math.log(rate) > PATIENCE)
        if slow and block.shape[1] < dim:
            block = np.linalg.qr(np.concatenate([moved, ritz], axis=1))[0][:, : min(dim, 2 * block.shape[1])]
            before = math.inf
        else:
            # moved again by the Ritz vectors at full width, where the image of a null space would leave the span
            block = np.linalg.qr(moved if block.shape[1] < dim else ritz)[0]
            before = worst


def fit_whitening(vectors: DataFrame, k: int = COMPONENTS, width: int = WIDTH) -> Whitening | None:
    """The k leading components of distinct vectors, rows (x array of long); None where there are none.

    The driver gets sums and block products, one row a dimension, and no vectors.
    """
    dim = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if dim <= 0:
        return None
    sums = vectors.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).orderBy("i").collect()
    n, sums = vectors.count(), [int(r.s) for r in sums]
    mean = np.array([s / n for s in sums])
    trace = float(_summed(vectors, dim, lambda x: np.square(x - mean).sum(axis=0)[:, None], 1).sum()) / n

    def apply(block: np.ndarray) -> np.ndarray:
        return _summed(vectors, dim, lambda x: (x - mean).T @ ((x - mean) @ block), block.shape[1]) / n

    values, axes, passes = subspace_iteration(apply, dim, k, width)
    kept = values > ZERO * max(values[0], 0) if values[0] > 0 else np.zeros(len(values), bool)
    values, axes = values[kept], axes[:, kept]
    if not len(values):
        return Whitening(n, sums, values, axes, trace, 0.0, passes)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
    onto = axes / np.sqrt(values)
    # covariance of the whitened list, centred on its own means, which are zero but for rounding
    second = _summed(vectors, dim, lambda x: np.concatenate([((x - mean) @ onto).T @ ((x - mean) @ onto), ((x - mean) @ onto).sum(axis=0)[None]]), len(values)) / n
    error = float(np.abs(second[:-1] - np.outer(second[-1], second[-1]) - np.eye(len(values))).max())
    return Whitening(n, sums, values, axes, trace, error, passes)


def _projected(model: Whitening) -> object:
    """Vectors to a row for each component."""
    dim, k, n = len(model.sums), len(model.values), model.n
    sums, mean, onto = np.array(model.sums, dtype=object), np.array([s / n for s in model.sums]), model.vectors / np.sqrt(model.values)
    most = max(map(abs, model.sums))

    def deviations(x: np.ndarray) -> list[int]:
        if dim * (n * int(np.abs(x).max(initial=0)) + most) ** 2 <= LONG:
            return np.square(n * x - np.array(model.sums)).sum(axis=1).tolist()
        out = np.square(n * x.astype(object) - sums).sum(axis=1).tolist()
        if max(out, default=0) > LONG:
            raise OverflowError("a deviation is no long: scale or fit fewer vectors")
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            white = (x - mean) @ onto
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.repeat(np.array(deviations(x), dtype=np.int64), k)), pa.array(white.ravel())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, width: int = WIDTH) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or has a null or no finite number, go. The components are those of the distinct vectors of
    whole numbers floor(scale * c). Vectors shorter than the longest are filled up with zeros, empty ones too. There are
    fewer components where there are fewer dimensions, or where the rest of the variance is zero: none for a single
    distinct vector or an empty table, which give no rows. Repeated rows give their rows again; a null id stays null. A
    deviation beyond a long is an error, never wrapped. Other columns are ignored.
    """
    spark = rows.sparkSession
    shared = Shared(spark)
    arrow_batches(spark, BATCH)
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(finite(F.col("v"))).select("id", whole_numbers(F.col("v"), scale).alias("x"))
    longest = own.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(longest) - F.size("x")))
    own = shared.keep(own.select("id", filled.alias("x")), "vectors")
    fit = shared.keep(own.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "fit")
    model = fit_whitening(fit, k, width) if longest else None
    schema = "id {}, component int, deviation long, whitened double".format(own.schema["id"].dataType.simpleString())
    if model is None or not len(model.values):
        out = spark.createDataFrame([], schema).withColumn("n", F.lit(0).cast("long")).withColumn("explained", F.lit(0.0)).withColumn("identity_error", F.lit(0.0))
    else:
        explained = F.element_at(F.array(*[F.lit(float(v) / model.trace) for v in model.values]), F.col("component"))
        out = own.mapInArrow(_projected(model), schema).withColumn("n", F.lit(model.n).cast("long")).withColumn("explained", explained).withColumn("identity_error", F.lit(model.identity_error))
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")
