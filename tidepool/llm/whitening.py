"""Embedding whitening from a compensated covariance.

Entries become whole numbers, x = floor(scale * c), and each distinct x counts
once in the fit. With the sums S of the n fitted vectors known, a vector is
centred as n * x - S, which is a whole number and so exact. Each task adds up the
outer products of its centred vectors in double-double: a centred entry is split
into slices of so few bits that a block's products of two slices are summed
without rounding by a matrix product, and these exact parts are added by
two-sum, which keeps what a sum rounds away in a low part. High and low parts of
the tasks are merged the same way, as a tree of groups, one for each row of the
matrix. What is left is a matrix of the vectors' width; its eigenvectors come
from LAPACK's divide-and-conquer solver of the tridiagonal form (syevd).

The result of the fit passes through the driver: n, S, the covariance, which
don't grow with the rows. Vectors are dealt by their own values, so a vector that a
third of all rows hold is one row of the fit.

Defined results: a row whose vector is null, empty, or holds a null or a
non-finite entry is dropped. Vectors of several lengths are not one space: the
length of most distinct vectors is fitted (of equals, the smaller), the rows of
others are dropped. Components whose eigenvalue is 0 up to rounding have no
whitened value and no rows, so at most n - 1 components exist. Repeated rows and
null ids stay, each a row. Entries so large that the exact deviation leaves 64
bits are an error. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut

#: Vectors whose slices are multiplied at once; products of two slices of SLICE_BITS then fit 53 bits.
BLOCK, SLICE_BITS = 4096, 20
#: Partial matrices that one group of the merge tree adds up.
FAN_IN = 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and what its rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(high: np.ndarray, low: np.ndarray, more: np.ndarray, more_low: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, np.asarray(more_low) + np.zeros_like(low))
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def slices(y: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as sums of doubles of at most SLICE_BITS significant bits each."""
    out, left, shift = [], y.copy(), 0
    while left.any() or not out:
        low = left & ((1 << SLICE_BITS) - 1) if int(np.abs(left).max(initial=0)) >> SLICE_BITS else left
        out.append(np.ldexp(low.astype(np.float64), shift))
        left = (left - low) >> SLICE_BITS
        shift += SLICE_BITS
    return out


def outer_sums(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum over the rows of y of their outer products; y holds whole numbers below 2^62."""
    d = y.shape[1]
    high, low = np.zeros((d, d)), np.zeros((d, d))
    for at in range(0, len(y), BLOCK):
        parts = slices(y[at : at + BLOCK])
        for a in parts:
            for b in parts:
                high, low = add(high, low, a.T @ b)  # exact: no product's sum leaves 53 bits
    return high, low


def usable(df: DataFrame, vec_col: str, scale: int) -> Column:
    """The vector as array<long>; null for rows that are dropped."""
    c = F.col(vec_col)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(c.isNotNull() & (F.size(c) > 0) & fine, F.transform(c, lambda x: F.floor(scale * x.cast("double")).cast("long")))


@dataclass(frozen=True)
class Fit:
    """What whitens: n vectors with sums, the covariance, and the components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # a row a component
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact; an error where that leaves 62 bits."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) >= 2**62:
            raise OverflowError("centred entries do not fit 62 bits")
        return self.n * x - np.array(self.sums, np.int64)

    def whitened(self, y: np.ndarray, components: int) -> np.ndarray:
        w = self.vectors[:components] / np.sqrt(self.values[:components])[:, None]
        return (y.astype(np.float64) / self.n) @ w.T


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def fit(distinct: DataFrame) -> Fit | None:
    """Of distinct vectors x, array<long> of one length; None if there are none."""
    totals = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not totals:
        return None
    n, sums, d = totals[0]["n"], tuple(r["s"] for r in totals), len(totals)
    base = Fit(n, sums, np.zeros((d, d)), np.zeros(d), np.eye(d), 0.0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        high, low = np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                high, low = add(high, low, *outer_sums(base.centred(_stacked(batch.column(0).slice(at, BLOCK), d))))
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield pa.RecordBatch.from_pydict({"task": [task] * d, "i": list(range(d)), "high": list(high), "low": list(low)})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("task")
        high, low = np.zeros(d), np.zeros(d)
        for h, e in zip(rows["high"], rows["low"], strict=True):
            high, low = add(high, low, np.asarray(h), np.asarray(e))
        return pd.DataFrame({"task": [rows["task"].iloc[0] // FAN_IN], "i": [rows["i"].iloc[0]], "high": [high], "low": [low]})

    kind = "task long, i long, high array<double>, low array<double>"
    tasks = distinct.rdd.getNumPartitions()
    parts = distinct.select("x").mapInArrow(partial, kind)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("group", F.floor(F.col("task") / FAN_IN)).groupBy("group", "i").applyInPandas(merged, kind)
    rows = parts.orderBy("i").collect()
    # divided by n * n of the centring and by n of the mean
    v = (np.array([r["high"] for r in rows]) + np.array([r["low"] for r in rows])) / float(n) / float(n) / float(n)
    v = (v + v.T) / 2
    values, vectors = np.linalg.eigh(v)
    return Fit(n, sums, v, values[::-1].copy(), vectors.T[::-1].copy(), float(np.trace(v)))


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """id, component int from 1, n long, deviation long, whitened double, explained double, identity_error double.

    identity_error is the largest absolute entry of the whitened fit's covariance minus the identity.
    """
    out = f"{id_col} {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    own = rows.select(id_col, usable(rows, vec_col, scale).alias("x")).where("x is not null")
    distinct = cut(own.select("x").distinct())
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return rows.sparkSession.createDataFrame([], out)
    width = lengths[0]["d"]
    own, distinct = own.where(F.size("x") == width), distinct.where(F.size("x") == width)
    f = fit(distinct)
    assert f is not None
    k = min(components, int((f.values > f.values[0] * width * np.finfo(float).eps).sum()) if f.values[0] > 0 else 0)
    if k == 0:
        return rows.sparkSession.createDataFrame([], out)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = f.whitened(f.centred(_stacked(batch.column(0), width)), k)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    # covar_pop centres before it multiplies
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    table = distinct.select("x").mapInArrow(project, ", ".join(f"w{i} double" for i in range(k)))
    spread = table.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, spread, strict=True))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                y = f.centred(_stacked(part.column(1), width))
                if width * float(np.abs(y).max(initial=0)) ** 2 >= 2.0**62:
                    deviation = [sum(int(v) ** 2 for v in row) for row in y]  # one beyond 64 bits is an error of the column
                else:
                    deviation = (y * y).sum(axis=1)
                m = part.num_rows
                ids = part.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), pa.array(np.repeat(np.array(deviation, object), k), pa.int64()), pa.array(f.whitened(y, k).ravel()), pa.array(np.tile(f.values[:k] / f.trace, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return own.mapInArrow(apply, out)
