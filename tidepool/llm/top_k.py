"""Exact top-k search by tiled integer matrix products.

Queries and candidates are dealt into tiles by a hash of their id. A cell of the
tile grid multiplies one query tile by one candidate tile, selects the k best of
each query within the tile, and the short lists are merged as a tree: first
among groups of candidate tiles, then over all of them.

Both tiles of a cell hold a bounded number of rows, whatever the size of the
tables, so no side is broadcast and none passes through the driver. A row of
candidates is copied once for every ``query_rows`` queries and a query once for
every ``candidate_rows`` candidates, so a cell shuffles one row for thousands of
products. Of candidates that repeat id and vector at most k copies are dealt
out, as more can't be in any list.

Scores are exact: products run in floating point where no sum can leave 53 bits,
in 64-bit integers where none can leave those, and else in Python's integers. A
score that is among the results but doesn't fit a long raises an error.

Defined results: a row whose id or vector is null, or whose vector is empty or
holds a null or a non-finite component, takes no part; any finite component
does. A query meets only vectors of its own length. Rows that repeat a
candidate's id count as rows of their own, but never as partners of the query
with that id; a query id given twice is searched once, by its smallest vector.
Equal scores go by smaller id. Extra columns are ignored. Empty tables give an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTIAL = "query_id long, vec_id long, score long, beyond boolean, tile int"
LEAST, MOST = -(2**63), 2**63 - 1


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): the vectors as doubles; rows that take no part are gone."""
    comp = F.col(vec_col)
    ok = F.col(id_col).isNotNull() & comp.isNotNull() & (F.size(comp) > 0)
    finite = F.forall(comp, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.where(ok).where(finite).select(F.col(id_col).cast("long").alias("id"), F.transform(comp, lambda x: x.cast("double")).alias("v"))


def quantized(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): whole numbers as floats where these hold them exactly, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(v * scale)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(x) * scale if abs(x) > 2**60 else math.floor(x * scale) for x in row] for row in v.tolist()], object)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of whole numbers; an object array where they could leave 64 bits."""
    top = max(map(abs, q.ravel().tolist()), default=0) * max(map(abs, c.ravel().tolist()), default=0) * q.shape[1] if q.dtype == object or c.dtype == object else float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if top < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if top < 2**62 and max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], object).reshape(x.shape)
    return whole(q) @ whole(c).T


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores) of the k best candidates of each query; ties to the smaller id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q_ids), block):
        s = _product(q[at : at + block], c)
        own = q_ids[at : at + block, None] == c_ids[None, :]
        for i in range(len(s)):
            keep = np.flatnonzero(~own[i])
            row = s[i, keep]
            if len(row) > k:
                least = (np.sort(row) if row.dtype == object else np.partition(row, len(row) - k))[len(row) - k]
                sure = np.flatnonzero(row > least)
                tied = np.flatnonzero(row == least)[: k - len(sure)]  # ids ascend, so the first are the smallest
                pick = np.concatenate([sure, tied])
            else:
                pick = np.arange(len(row))
            out.append((np.full(len(pick), q_ids[at + i]), c_ids[keep[pick]], row[pick]))
    if not out:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def exact_top_k(queries: DataFrame, candidates: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: int = 256, query_rows: int = 8192, candidate_rows: int = 8192, fan_in: int = 16) -> DataFrame:
    """query_id long, rank int from 1, vec_id long, score long."""
    q, c = usable(queries, id_col, vec_col), usable(candidates, id_col, vec_col)
    q = q.groupBy("id").agg(F.min("v").alias("v"))
    c = c.groupBy("id", "v").agg(F.count("*").alias("n")).select("id", "v", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int"))).alias("copy"))
    n_q, n_c = max(1, -(-queries.count() // query_rows)), max(1, -(-candidates.count() // candidate_rows))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.select(F.pmod(F.xxhash64("id"), F.lit(n_q)).cast("int").alias("qt"), every(n_c).alias("ct"), F.size("v").alias("dim"), "id", "v")
    c = c.select(every(n_q).alias("qt"), F.pmod(F.xxhash64("id", "v", "copy"), F.lit(n_c)).cast("int").alias("ct"), F.size("v").alias("dim"), "id", "v")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "beyond": [], "tile": []})
        a, b, s = best_of_tile(left["id"].to_numpy(), quantized(np.stack(left["v"].to_numpy()), scale), right["id"].to_numpy(), quantized(np.stack(right["v"].to_numpy()), scale), k)
        beyond = np.array([not LEAST <= x <= MOST for x in s.tolist()], bool) if s.dtype == object else np.zeros(len(s), bool)
        if s.dtype == object:
            s = np.array([min(max(x, LEAST), MOST) for x in s.tolist()], np.int64)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": s, "beyond": beyond, "tile": int(right["ct"].iloc[0])})

    part = q.groupBy("qt", "ct", "dim").cogroup(c.groupBy("qt", "ct", "dim")).applyInPandas(cell, PARTIAL)
    while n_c > 1:  # the merge tree: fan_in lists of a query become one
        n_c = -(-n_c // fan_in)
        part = part.withColumn("tile", F.floor(F.col("tile") / fan_in).cast("int"))
        part = _first(part, ["query_id", "tile"], k).drop("rank")
    last = _first(part, ["query_id"], k)
    score = F.when(F.col("beyond"), F.raise_error(F.lit("a score among the results does not fit 64 bits")).cast("long")).otherwise(F.col("score"))
    return last.select("query_id", "rank", "vec_id", score.alias("score"))


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    from pyspark.sql import Window

    # a score held at the least long stands behind a true one
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("beyond"), F.asc("vec_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
