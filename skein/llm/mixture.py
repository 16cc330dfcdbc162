"""Gaussian mixture by expectation-maximization over a distributed table of vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial sums of so many tasks go to the driver at once; more are added up in a tree first.
AT_ONCE = 64


@dataclass
class Mixture:
    """Weights (k), means (k, d) and covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    def coefficients(self) -> np.ndarray:
        """The matrix that turns :func:`moments` into log densities of the components."""
        k, d = self.means.shape
        iu = np.triu_indices(d)
        twice = np.where(iu[0] == iu[1], 1.0, 2.0)
        out = np.empty((1 + d + len(iu[0]), k))
        for j in range(k):
            inv = np.linalg.inv(self.covs[j])
            m = self.means[j]
            out[0, j] = np.log(self.weights[j] + 1e-300) - 0.5 * (m @ inv @ m + np.linalg.slogdet(self.covs[j])[1] + d * np.log(2 * np.pi))
            out[1 : 1 + d, j] = inv @ m
            out[1 + d :, j] = -0.5 * twice * inv[iu]
        return out


def moments(x: np.ndarray) -> np.ndarray:
    """1, the coordinates and their products, of each row."""
    iu = np.triu_indices(x.shape[1])
    return np.concatenate([np.ones((len(x), 1), dtype=x.dtype), x, x[:, iu[0]] * x[:, iu[1]]], axis=1)


def posteriors(x: np.ndarray, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Moments, component probabilities and log likelihood of each row."""
    phi = moments(x)
    lp = phi @ coefficients
    top = lp.max(axis=1, keepdims=True)
    r = np.exp(lp - top)
    s = r.sum(axis=1, keepdims=True)
    return phi, r / s, (top + np.log(s))[:, 0]


def rows_of(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def from_moments(total: np.ndarray, d: int, floor: float) -> Mixture:
    """The mixture that has the given moments (k, 1 + d + d(d+1)/2); ``floor`` is added to every variance."""
    iu = np.triu_indices(d)
    n = np.maximum(total[:, 0], 1e-9)
    means = total[:, 1 : 1 + d] / n[:, None]
    covs = np.empty((len(n), d, d))
    for j in range(len(n)):
        c = np.zeros((d, d))
        c[iu] = total[j, 1 + d :] / n[j]
        c = np.triu(c) + np.triu(c, 1).T - np.outer(means[j], means[j])
        w, v = np.linalg.eigh(c)
        covs[j] = (v * (np.maximum(w, 0) + floor)) @ v.T
    return Mixture(n / n.sum(), means, covs)


def _sum_by_tree(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """Sum of the vectors ``m`` of ``parts``, one of each task."""
    while tasks > AT_ONCE:
        tasks = -(-tasks // AT_ONCE)

        def add(key: tuple, t: pa.Table) -> pa.Table:
            return pa.table({"task": [key[0].as_py()], "m": [rows_of(t.column("m").combine_chunks()).sum(axis=0)]}, schema=pa.schema([("task", pa.int32()), ("m", pa.list_(pa.float64()))]))

        parts = parts.withColumn("task", F.floor(F.col("task") / AT_ONCE).cast("int")).groupBy("task").applyInArrow(add, "task int, m array<double>")
    rows = [np.asarray(r["m"]) for r in parts.collect()]
    return np.sum(rows, axis=0) if rows else None


def fit(vectors: DataFrame, column: str, start: np.ndarray, iterations: int = 12, floor: float = 0.05, tolerance: float = 1e-3) -> Mixture:
    """Mixture fitted to all rows of ``vectors`` (an array<double> ``column``), from the moments ``start`` of its components.

    ``start`` also stays as so many observations as its first column says, so a component without rows keeps its place.
    Each iteration is one pass in which a task adds up the moments of its rows; the driver gets one such sum of each of at
    most ``AT_ONCE`` tasks. ``vectors`` is read in every iteration: pass a written or checkpointed table.
    """
    d = int((np.sqrt(9 + 8 * (start.shape[1] - 1)) - 3) / 2)
    k = len(start)
    mixture = from_moments(start, d, 0.3)
    last = -np.inf
    tasks = vectors.rdd.getNumPartitions()
    for _ in range(iterations):
        theta = mixture.coefficients()

        def partial(batches: Iterable[pa.RecordBatch], theta: np.ndarray = theta) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, ll = np.zeros((k, theta.shape[0])), 0.0
            theta = theta.astype(np.float32)  # single precision within a block, sums of blocks in double
            for b in batches:
                x = rows_of(b.column(0)).astype(np.float32)
                for at in range(0, len(x), 4096):
                    phi, r, each = posteriors(x[at : at + 4096], theta)
                    total += r.T @ phi
                    ll += float(each.sum(dtype=np.float64))
            ctx = TaskContext.get()
            yield pa.RecordBatch.from_arrays([pa.array([ctx.partitionId() if ctx else 0], pa.int32()), pa.array([np.append(total.ravel(), ll)], pa.list_(pa.float64()))], names=["task", "m"])

        total = _sum_by_tree(vectors.select(column).mapInArrow(partial, "task int, m array<double>"), tasks)
        if total is None or total[:-1].sum() == 0:
            return mixture
        sums, ll = total[:-1].reshape(k, -1), total[-1] / total[:-1].reshape(k, -1)[:, 0].sum()
        mixture = from_moments(sums + start, d, floor)
        if abs(ll - last) < tolerance:
            break
        last = ll
    return mixture
