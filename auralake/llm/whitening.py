"""Whitening of vectors: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Spark adds up counts, sums and centred products over all vectors.  The scatter is
factored with pivoting into a lower triangle; rotations of its columns make them
orthogonal, and then their squared norms are the eigenvalues and the normalised
columns the components.  Every vector is centred and projected where it lies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auralake.llm.vectors import matrices, scaled, usable


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """(d, rank) factor g with g @ g.T = a; its rows, in order of the pivots, are a lower triangle."""
    a = a.astype(float).copy()
    d = len(a)
    order, g = np.arange(d), np.zeros((d, d))
    limit = d * np.finfo(float).eps * np.diagonal(a).max(initial=0.0)
    for k in range(d):
        pivot = k + int(np.argmax(np.diagonal(a)[k:]))
        if not a[pivot, pivot] > limit:
            return _unpivoted(g[:, :k], order)
        for m in (a, a.T, g, order):
            m[[k, pivot]] = m[[pivot, k]]
        g[k:, k] = a[k:, k] / math.sqrt(a[k, k])
        a[k:, k:] -= np.outer(g[k:, k], g[k:, k])
    return _unpivoted(g, order)


def _unpivoted(g: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(g)
    out[order] = g
    return out


def _pairings(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs."""
    ring = list(range(n + n % 2))
    rounds = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(p), max(p)) for p in zip(ring[:half], reversed(ring[half:]), strict=True) if max(p) < n]
        rounds.append(tuple(np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return rounds


def one_sided_jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """g with its columns rotated until every two are orthogonal, by falling norm."""
    g = g.copy()
    rounds = _pairings(g.shape[1]) if g.shape[1] > 1 else []
    for _ in range(sweeps):
        worst = 0.0
        for i, j in rounds:
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            cosine = np.abs(c) / np.sqrt(np.maximum(a * b, np.finfo(float).tiny))
            worst = max(worst, float(cosine.max()))
            turn = cosine > 1e-16
            zeta = (b - a) / np.where(turn, 2 * c, 1.0)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.sqrt(1 + t * t)
            g[:, i], g[:, j] = cos * (x - t * y), cos * (y + t * x)
        if worst < 1e-15:
            break
    return g[:, np.argsort(-(g * g).sum(axis=0), kind="stable")]


def principal_components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, components as columns) of a positive semidefinite matrix; none for directions without variance."""
    g = one_sided_jacobi(pivoted_cholesky(scatter))
    values = (g * g).sum(axis=0)
    return values, g / np.sqrt(values)


def _sums(rows: DataFrame, terms, size: int) -> np.ndarray:
    """Sum over all rows of terms(matrix), `size` numbers: one array per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for _, x in matrices(batch, "x"):
                total += terms(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every vector and up to `components` components.

    Entries become x = floor(scale * entry) + offset.  n counts the vectors,
    deviation is the sum over dimensions of (n * x - sum of x)**2 (null where it
    doesn't fit a long), whitened the centred vector projected on the component
    and divided by the root of its eigenvalue, explained the eigenvalue's share
    of the total variance, identity_error the largest entry of the covariance of
    all whitened vectors minus the identity.

    Vectors that are null or hold null or non-finite entries are left out, and
    so are those of another length than most have (of equally frequent lengths
    the longest counts).  Directions without variance give no component: equal
    vectors only, or a single one, give no rows, as does an empty table.  Null
    and repeated ids pass through, repeated rows count each; other columns are
    ignored.  What reaches the driver is a few sums per pair of dimensions.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None or not lengths["d"]:
        return spark.createDataFrame([], schema)
    d, n = lengths["d"], lengths["n"]
    rows = rows.filter(F.size("v") == d).select("vec_id", scaled(F.col("v"), scale, offset).alias("x"))
    per_dimension = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [0] * d
    for r in per_dimension.collect():
        sums[r["i"]] = int(r["s"])
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole) - rest  # whole numbers first: exact

    scatter = _sums(rows, lambda x: (centred(x).T @ centred(x)).ravel(), d * d).reshape(d, d)
    values, vectors_ = principal_components((scatter + scatter.T) / 2)
    if not len(values):
        return spark.createDataFrame([], schema)
    explained = values / values.sum()
    k = min(components, len(values))
    project = vectors_[:, :k] / np.sqrt(values[:k] / n)

    def moments(x: np.ndarray) -> np.ndarray:
        z = centred(x) @ project
        return np.concatenate((z.sum(axis=0), (z.T @ z).ravel()))

    total = _sums(rows, moments, k + k * k) / n
    covariance = total[k:].reshape(k, k) - np.outer(total[:k], total[:k])  # the means are zero but for rounding
    error = float(np.abs(covariance - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch, "x"):
                m = len(at)
                columns = (
                    batch.column("vec_id").take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    pa.array(_deviations(x, n, sums)).cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((centred(x) @ project).ravel()),
                    pa.array(np.tile(explained[:k], m)),
                    pa.array(np.full(m * k, error)),
                )
                yield pa.RecordBatch.from_arrays(list(columns), names=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray | list[int | None]:
    """Sum over dimensions of (n * x - sums)**2 per row, exact; None beyond 64 bits."""
    largest = max(n * max(abs(int(x.max())), abs(int(x.min()))), *map(abs, sums), 1)
    if 2 * largest < 1 << 62:
        gap = n * x - np.array(sums, dtype=np.int64)
        if float(np.abs(gap).max()) ** 2 * x.shape[1] < 2.0**62:
            return (gap * gap).sum(axis=1)
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]
