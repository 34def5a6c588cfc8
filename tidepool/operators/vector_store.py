"""An approximate vector store: coarse cells, residual codes, exact re-ranking.

k-means over a bounded sample names the cells; every vector is stored in the cell
of its nearest centre, as codes of its residual: a byte for each stretch of the
vector, the nearest of 256 centroids that k-means finds for that stretch. A
question probes the cells with the nearest centres, adds up its tables of stretch
products for each code there, and the best candidates are scored exactly over
their whole vectors. The store is partitioned by cell, so a search reads the
probed cells alone. How many those must be for a recall of 0.9 and more is measured
on the sample and stored. ``search.vector_top_k`` is the exact way.

Likeness is the inner product, of any finite vectors. Bounded are the sample of
the fit (``SAMPLE_ROWS``) and the number of cells (``MOST_CELLS``), so the centres fit in
every task; every vector is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.checkpoint import cut

#: Rows that the centres are fitted on, and how many cells there are at most.
SAMPLE_ROWS, MOST_CELLS = 50_000, 4096
CODES = 256


def _stack(v) -> np.ndarray:
    return np.stack(list(v)).astype(np.float64) if len(v) else np.empty((0, 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row; of equals the first."""
    return np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k centres; those that lose all rows stay where they are."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int = 5, share: float = 0.97, asked: int = 300) -> int:
    """How many cells a question must probe so that they hold this share of its k best rows, over questions from the sample."""
    q = x[:: max(1, len(x) // asked)]
    products = q @ x.T
    k = min(k, len(x))
    best = np.argpartition(-products, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)  # of each cell in a question's order
    need = np.sort(np.take_along_axis(place, nearest(x, centres)[best], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(share * len(need))) - 1)]) + 1


@dataclass(frozen=True)
class VectorStore:
    """rows: id, embedding, codes, cell (a partition of the files). books: the centroids of each stretch. probes: cells that a search probes."""

    rows: DataFrame
    centres: np.ndarray
    books: list[np.ndarray]
    probes: int
    id_col: str


def _tables(books: list[np.ndarray], q: np.ndarray) -> list[np.ndarray]:
    """A question's products with every centroid, stretch by stretch."""
    ends = np.cumsum([0, *(b.shape[1] for b in books)])
    return [b @ q[a:z] for b, a, z in zip(books, ends[:-1], ends[1:], strict=True)]


def build(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None, stretches: int = 8) -> VectorStore:
    """Writes the store; rows without a vector or with a null or non-finite entry are not stored."""
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    own = vectors.where(fine).select(id_col, F.transform(v, lambda x: x.cast("double")).alias("embedding"))
    n = own.count()
    # the rows whose hashes come first: the same sample whatever the partitions
    sample = own.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE_ROWS).toPandas() if n else None
    if sample is None:
        raise ValueError("no vectors to store")
    x = _stack(sample["embedding"])
    cells = min(MOST_CELLS, cells or max(1, int(np.sqrt(n))))
    centres = k_means(x, cells)
    residual = x - centres[nearest(x, centres)]
    books = [k_means(part, CODES) for part in np.array_split(residual, min(stretches, x.shape[1]), axis=1)]
    kind = own.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _stack(b["embedding"])
                cell = nearest(x, centres)
                parts = np.array_split(x - centres[cell], len(books), axis=1)
                codes = np.stack([nearest(p, c) for p, c in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
                yield b.assign(codes=[c.tobytes() for c in codes], cell=cell.astype(np.int32))

    coded = own.mapInPandas(code, f"{id_col} {kind}, embedding array<double>, codes binary, cell int")
    # a cell that very many vectors share is written by several tasks
    salt = F.pmod(F.xxhash64(id_col), F.lit(4))
    coded.repartition("cell", salt).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    spark = vectors.sparkSession
    model = [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [(f"book{j}", i, c.tolist()) for j, b in enumerate(books) for i, c in enumerate(b)]
    model.append(("probes", 0, [float(probes_needed(x, centres))]))
    spark.createDataFrame(model, "part string, i int, v array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return open_store(spark, path, id_col)


def open_store(spark: SparkSession, path: str, id_col: str = "vec_id") -> VectorStore:
    model = spark.read.parquet(f"{path}/centres").orderBy("part", "i").toPandas()
    of = {p: _stack(g["v"]) for p, g in model.groupby("part")}
    centres, probes = of.pop("centre"), int(of.pop("probes")[0, 0])
    return VectorStore(spark.read.parquet(f"{path}/vectors"), centres, [of[p] for p in sorted(of, key=lambda p: int(p[4:]))], probes, id_col)


def probed(store: VectorStore, queries: DataFrame, probes: int) -> DataFrame:
    """query_id, q, cell: the cells with the centres of the highest products."""
    centres, kind = store.centres, queries.schema["query_id"].dataType.simpleString()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = _stack(b["q"]) @ centres.T
                top = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                m = top.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(b["query_id"].to_numpy(), m), "q": [v for v in b["q"] for _ in range(m)], "cell": top.ravel().astype(np.int32), "base": np.take_along_axis(s, top, 1).ravel()})

    return queries.where("embedding is not null").select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("q")).mapInPandas(choose, f"query_id {kind}, q array<double>, cell int, base double")


def approximate_top_k(store: VectorStore, queries: DataFrame, k: int = 5, probes: int | None = None, candidates: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank. queries: query_id, embedding.

    The ``candidates`` (20 * k) best of the probed cells by their codes are scored exactly.
    Rows that repeat an id are rows of their own. ``probes`` is the store's own number unless given; all cells with all candidates are exact.
    """
    keep, books, id_col = candidates or 20 * k, store.books, store.id_col
    plan = cut(probed(store, queries, probes or store.probes))
    # only the probed cells' files are read
    cells = [r[0] for r in plan.select("cell").distinct().collect()]
    rows = store.rows.where(F.col("cell").isin(cells))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), store.id_col: store.rows.schema[store.id_col].dataType.simpleString()}
    out = f"query_id {kinds['query_id']}, {store.id_col} {kinds[store.id_col]}, cell int, likeness double"

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[:0], id_col: right[id_col].to_numpy()[:0], "cell": np.empty(0, np.int32), "likeness": np.empty(0)})
        codes = np.frombuffer(b"".join(right["codes"]), np.uint8).reshape(len(right), -1)
        ids, found = right[id_col].to_numpy(), []
        for query, q, base in zip(left["query_id"], left["q"], left["base"], strict=True):
            s = base + sum(t[codes[:, j]] for j, t in enumerate(_tables(books, np.asarray(q, float))))
            top = np.argpartition(-s, keep - 1)[:keep] if len(s) > keep else np.arange(len(s))
            found.append((np.full(len(top), query), ids[top], s[top]))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": a, id_col: b, "cell": left["cell"].iloc[0], "likeness": c})

    # codes alone go to the scan, dealt in slices of a cell
    slices = max(1, -(-store.rows.count() // (len(store.centres) * 16_384)))
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    coded = rows.select("cell", F.pmod(F.xxhash64(store.id_col), F.lit(slices)).cast("int").alias("slice"), store.id_col, "codes")
    found = plan.select("*", every.alias("slice")).groupBy("cell", "slice").cogroup(coded.groupBy("cell", "slice")).applyInPandas(scan, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("likeness"), store.id_col)
    some = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep).select("query_id", store.id_col, "cell").distinct()
    asked = plan.select("query_id", "q").dropDuplicates(["query_id"])
    whole = rows.select("cell", store.id_col, "embedding").join(some, ["cell", store.id_col]).join(asked, "query_id")
    score = F.round(F.aggregate(F.zip_with("embedding", "q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), digits)
    scored = whole.select("query_id", store.id_col, score.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), store.id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> float:
    """The share of the exact results that were found."""
    both = exact.join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left").agg(F.count("hit"), F.count("*")).first()
    return both[0] / both[1] if both[1] else 1.0
