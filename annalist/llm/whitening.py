"""Whitening of embeddings: the leading eigenvectors of their covariance by LOBPCG, and rows projected on them.

The data stay on the cluster: a product of the covariance with a block of directions is one pass over the centred rows, in which
every task sums its own rows and tasks' sums are added in a second, smaller step. Only blocks of dimensions by directions reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Steps of a unit, the shift, components. Then directions kept beside them, and passes at most.
STEPS, SHIFT, COMPONENTS, GUARD, PASSES = 64, 1_000_000, 16, 8, 500
#: An entry beyond this has no whole number of steps that a double tells apart.
LARGEST = float(1 << 46)
#: What a residual's norm may be of the largest eigenvalue for a pair to be certified, and where iterating ends.
CERTIFIED, AIM = 1e-10, 2e-15
#: Tasks' sums that are read by the driver at most.
SUMS = 16


def whole_steps(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(vec_id, x): whole steps of each entry, of rows whose vector has entries, all of them finite numbers of less than 2 ** 46."""
    c = F.col(vector)
    fine = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= LARGEST))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).alias("vec_id"), F.transform(c, lambda v: F.floor(v.cast("double") * STEPS) + SHIFT).alias("x"))


def matrix(col: pa.Array) -> np.ndarray:
    """A batch's vectors of equal length as rows."""
    return col.flatten().to_numpy().reshape(len(col), -1) if len(col) else np.zeros((0, 0), dtype=np.int64)


def summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray], col: str = "x") -> np.ndarray | None:
    """The sum of of(rows) over all batches of a column of vectors: tasks' sums are added in up to 16 tasks, then on the driver.

    Sums are added in the order of task numbers, so a run gives what the run before it gave. None without rows.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = of(matrix(batch.column(0)))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    sample = of(np.zeros((1, len(rows.select(col).first()[0])), dtype=np.int64)) if rows.limit(1).count() else None
    if sample is None:
        return None
    kind, shape = sample.dtype, sample.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros(shape, kind), None
        for batch in batches:
            for n, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
                total, least = total + np.frombuffer(sums, kind).reshape(shape), n if least is None else least
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    schema = "part long, sums binary"
    parts = rows.select(col).mapInArrow(part, schema).repartition(SUMS, "part").sortWithinPartitions("part").mapInArrow(add, schema)
    total = np.zeros(shape, kind)
    for r in sorted(parts.collect(), key=lambda r: r["part"]):  # at most SUMS blocks of dimensions by directions
        total += np.frombuffer(r["sums"], kind).reshape(shape)
    return total


def _moments(x: np.ndarray) -> np.ndarray:
    """Rows and sums by dimension, exact."""
    return np.concatenate([[len(x)], x.sum(axis=0)]).astype(np.int64)


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n in double precision, from exact whole numbers."""
    q, r = np.divmod(s, n)
    return (x - q).astype(np.float64) - r / n


def covariance_product(fit: DataFrame, n: int, s: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The covariance of the rows times a block of directions, by one pass over centred rows."""

    def of(x: np.ndarray) -> np.ndarray:
        c = centred(x, n, s)
        return c.T @ (c @ block)

    return summed(fit, of) / n


def _orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span a block, without what the other blocks span; those that are nearly within it are left out."""
    out = block / np.maximum(np.linalg.norm(block, axis=0), 1e-300)
    for _ in range(3):
        for a in against:
            out = out - a @ (a.T @ out)
        u, size, _ = np.linalg.svd(out, full_matrices=False)
        out = u[:, size > 1e-8 * max(size.max(initial=0), 1e-6)] if out.shape[1] else out
    return out


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, passes: int = PASSES, trace: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix that only its product is given of, unit eigenvectors as columns, and residual norms.

    Each round asks for one product, with the residuals and previous directions that the iterate doesn't span, and takes the best of the
    joint span (Rayleigh-Ritz). It ends where the residuals of the first k, from a fresh product, are at rounding size or get no
    less; an error is raised where they aren't certified then.
    """
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(7).standard_normal((d, m)))[0]
    ax, p = product(x), np.zeros((d, 0))
    best, stalled, fresh = np.inf, 0, True
    for _ in range(passes):
        e, c = np.linalg.eigh((h := x.T @ ax) / 2 + h.T / 2)
        e, c = e[::-1], c[:, ::-1]
        x, ax = x @ c, ax @ c
        residual = ax - x * e
        norms = np.linalg.norm(residual[:, :k], axis=0)
        scale = max(e[0], 0.0)
        if scale <= 1e-300 or m == d and fresh or norms.max() <= AIM * d * scale:
            if fresh:
                break
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            continue
        if norms.max() < 0.7 * best:
            best, stalled = norms.max(), 0
        elif norms.max() <= CERTIFIED * scale:
            stalled += 1
            if stalled > 3 and fresh:
                break
            if stalled > 3:
                x = np.linalg.qr(x)[0]
                ax, fresh = product(x), True
                continue
        w = _orthonormal(residual, x)
        q = np.concatenate([w, _orthonormal(p, x, w)], axis=1)[:, : d - m]
        if not q.shape[1]:
            x = np.linalg.qr(x)[0]
            ax, fresh = product(x), True
            p = np.zeros((d, 0))
            stalled += 1
            if stalled > 3:
                break
            continue
        aq, fresh = product(q), False
        s, a_s = np.concatenate([x, q], axis=1), np.concatenate([ax, aq], axis=1)
        h = s.T @ a_s
        c = np.linalg.eigh(h / 2 + h.T / 2)[1][:, ::-1][:, :m]
        p = q @ c[m:]
        x, ax = s @ c, a_s @ c
    e = np.sum(x * ax, axis=0)
    order = np.argsort(-e)[:k]
    x, ax, e = x[:, order], ax[:, order], e[order]
    norms = np.linalg.norm(ax - x * e, axis=0)
    if norms.max(initial=0) > CERTIFIED * max(e.max(initial=0), 1e-300):
        raise ValueError(f"the eigenvectors weren't certified after {passes} passes: residuals up to {norms.max():.3g}")
    return e, x, norms


def whitened(vectors: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Rows projected on the leading eigenvectors and scaled to unit variance, one row a vector and component.

    vec_id, component (from 1), n (distinct vectors fitted on), deviation, whitened, explained, identity_error, residual (largest
    certified residual norm over the largest eigenvalue). Rows with a null or empty vector, a null or non-finite entry, or one of
    2 ** 46 and more take no part; of vectors of different lengths, only those of the commonest length (ties: the shorter) do.
    Copies count once in the fit and each get their rows; null and repeated ids stay. Components whose eigenvalue is zero to rounding
    have no whitened value and aren't returned: fewer than 16 distinct vectors give fewer components, one vector gives none. deviation
    is a long; where it can't be one, an error is raised.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    rows = whole_steps(vectors, vector, id_col)
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None:
        return spark.createDataFrame([], schema)
    d = size["d"]
    rows = rows.where(F.size("x") == d)
    fit = staged(rows.select("x").distinct())
    moments = summed(fit, _moments)
    n, s = int(moments[0]), moments[1:]
    trace = float(summed(fit, lambda x: (centred(x, n, s) ** 2).sum(axis=0)).sum() / n)
    e, v, norms = lobpcg(lambda block: covariance_product(fit, n, s, block), d, min(components, d), trace=trace)
    kept = e > 1e-13 * max(trace, 0) * d
    scaled = v[:, kept] / np.sqrt(e[kept])
    k = scaled.shape[1]
    if not k:
        return spark.createDataFrame([], schema)
    gram = summed(fit, lambda x: (w := centred(x, n, s) @ scaled).T @ w) / n
    error, residual = float(np.abs(gram - np.eye(k)).max()), float(norms[kept].max() / e[0])
    explained = e[kept] / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = matrix(part.column("x"))
                white = centred(x, n, s) @ scaled
                far = np.abs(centred(x, n, s)).max() * n  # about the largest |n * x - s|
                away = (n * x - s) if d * (far + 1) ** 2 < 2**62 else n * x.astype(object) - s
                deviation = (away * away).sum(axis=1)
                rows_ = np.repeat(np.arange(len(x)), k)
                many = len(rows_)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(rows_)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(many, n)), pa.array(np.repeat(deviation, k).tolist(), pa.int64()),
                     pa.array(white.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error)), pa.array(np.full(many, residual))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"],
                )

    return rows.mapInArrow(project, schema)
