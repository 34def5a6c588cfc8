"""Lexical and vector top-k, and the fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.best import Best, by_passes

#: Questions whose scores over a tile of documents are held at once.
BLOCK_QUERIES = 128
#: Questions of a pass at most, on average; questions and documents whose scores are held at once.
PASS_QUERIES, SCAN_QUERIES, SCAN_DOCS = 32_768, 1_024, 1_024
SCAN = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(4 * SCAN_DOCS), "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ranked(scores: DataFrame, keys: Sequence[str], k: int | None, order: Sequence[Column]) -> DataFrame:
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, queries: DataFrame, group: Sequence[str] = (), id_col: str = "doc_key", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """query_id, group columns, doc id, score of every document that shares a token with the query.

    docs: group columns, id, tokens; queries: query_id, tokens and, if a query is for
    one group only, the group columns; without them it is asked of every group.
    Statistics are those of a group's documents alone. A token in over half of
    them gets ``epsilon`` times the group's mean idf. Repeated query tokens count
    again. Only tokens that are asked for are counted by document, and counts
    are combined before they are shuffled.
    """
    g = list(group)
    asked_of = [c for c in g if c in queries.columns]
    sizes = docs.select(*g, id_col, F.size("tokens").alias("dl"), "tokens")
    stats = sizes.groupBy(*g).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select(*asked_of, "query_id", F.explode("tokens").alias("token")).groupBy(*asked_of, "query_id", "token").agg(F.count("*").alias("qtf"))
    terms = asked.select(*asked_of, "token").dropDuplicates()
    tf = sizes.select(*g, id_col, "dl", F.explode("tokens").alias("token")).join(terms, [*asked_of, "token"], "left_semi").groupBy(*g, id_col, "dl", "token").agg(F.count("*").alias("tf"))
    df = sizes.select(*g, F.explode(F.array_distinct("tokens")).alias("token")).groupBy(*g, "token").agg(F.count("*").alias("df"))
    one = F.lit(1).alias("__all")
    keys = g or ["__all"]
    idf = (df if g else df.select("*", one)).join(stats if g else stats.select("*", one), keys)
    idf = idf.withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = idf.groupBy(*keys).agg(F.avg("idf").alias("mean_idf"))
    idf = idf.join(terms, [*asked_of, "token"], "left_semi").join(mean, keys)
    idf = idf.select(*g, "token", "avgdl", F.when(F.col("idf") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("idf")).alias("idf"))
    weight = tf.join(idf, [*g, "token"])
    weight = weight.withColumn("w", F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    return weight.join(asked, [*asked_of, "token"]).groupBy(*g, "query_id", id_col).agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int | None = 3, group: Sequence[str] = (), id_col: str = "doc_key", digits: int = 6) -> DataFrame:
    """The k best, by score rounded to ``digits`` and then by id; documents without a common token have no rank."""
    s = bm25_scores(docs, queries, group, id_col).withColumn("score", F.round("score", digits))
    return ranked(s, [*group, "query_id"], k, [F.desc("score"), F.asc(id_col)])


def bm25_within(rows: DataFrame, group: str, keep: Sequence[str] = (), id_col: str = "doc_key", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, digits: int = 6) -> DataFrame:
    """group, id, columns of ``keep``, score as ``bm25_scores`` gives them with one query a group.

    rows: group, id, tokens, asked (a map of the group's query tokens to their
    counts). All statistics are windows over the group, so rows that lie
    together by group are not shuffled again.
    """
    of_group, of_token = Window.partitionBy(group), Window.partitionBy(group, "token")
    own = [*keep, "dl", "n", "avgdl"]
    token = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.try_element_at("asked", t).alias("qtf")))
    sized = rows.select(group, id_col, *keep, token.alias("t"), F.size("tokens").alias("dl")).withColumn("n", F.count("*").over(of_group)).withColumn("avgdl", F.avg("dl").over(of_group))
    tf = sized.select(group, id_col, *own, F.explode("t").alias("t")).groupBy(group, id_col, F.col("t.token").alias("token")).agg(*[F.first(c).alias(c) for c in own], F.first("t.qtf").alias("qtf"), F.count("*").alias("tf"))
    idf = tf.withColumn("df", F.count("*").over(of_token)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    # a token stands in df rows, so its share of the group's mean idf is spread over them
    mean = F.sum(F.col("idf") / F.col("df")).over(of_group) / F.sum(1 / F.col("df")).over(of_group)
    weighed = idf.withColumn("idf", F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf"))).where("qtf is not null")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weighed.groupBy(group, id_col).agg(*[F.first(c).alias(c) for c in keep], F.round(F.sum(part), digits).alias("score"))


def token_counts(tokens: Column) -> Column:
    """A map of an array's tokens to how often they stand in it; for questions, which are short."""
    return F.map_from_arrays(F.array_distinct(tokens), F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda x: x == t))))


def vector_scores(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_key", vec_col: str = "embedding", file_col: str | None = None, query_rows: int = 4096, doc_rows: int = 8192) -> DataFrame:
    """query_id, id, score: inner products, the k best of each tile of docs and what ties with them.

    queries: query_id, vector and, with ``file_col``, the file it is limited to.
    Queries and docs are dealt into tiles of a bounded number of rows, by a hash
    of their ids; each cell of the grid is one matrix product.
    """
    n_q, n_d = max(1, -(-queries.count() // query_rows)), max(1, -(-docs.count() // doc_rows))
    files = [F.col(file_col).alias("file")] if file_col else []
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qt"), every(n_d).alias("dt"), "query_id", F.col(vec_col).alias("v"), *files)
    d = docs.where(F.col(vec_col).isNotNull()).select(every(n_q).alias("qt"), F.pmod(F.xxhash64(id_col), F.lit(n_d)).cast("int").alias("dt"), id_col, F.col(vec_col).alias("v"), *files)
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *docs.schema.fields]}

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[:0], id_col: right[id_col].to_numpy()[:0], "score": np.empty(0)})
        ours, theirs = (np.stack(rows["v"].to_numpy()).astype(np.float64) for rows in (left, right))
        if file_col:
            mine, files = left["file"].to_numpy(object), right["file"].to_numpy(object)
        top, found = min(k, len(right)), []
        for at in range(0, len(left), BLOCK_QUERIES):
            s = ours[at : at + BLOCK_QUERIES] @ theirs.T
            if file_col:
                s[mine[at : at + BLOCK_QUERIES, None] != files[None, :]] = -np.inf
            keep = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top] - 1e-9  # ties beyond the k-th go on
            x, y = np.nonzero((s >= keep[:, None]) & np.isfinite(s))
            found.append((x + at, y, s[x, y]))
        x, y, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[x], id_col: right[id_col].to_numpy()[y], "score": score})

    return q.groupBy("qt", "dt").cogroup(d.groupBy("qt", "dt")).applyInPandas(cell, f"query_id {kinds['query_id']}, {id_col} {kinds[id_col]}, score double")


def vector_top_k(docs: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "doc_key", vec_col: str = "embedding", file_col: str | None = None, digits: int = 6) -> DataFrame:
    s = vector_scores(docs, queries, k, id_col, vec_col, file_col).withColumn("score", F.round("score", digits))
    return ranked(s, ["query_id"], k, [F.desc("score"), F.asc(id_col)])


def _matrix(vectors: pa.Array) -> np.ndarray:
    return pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def vector_scan(docs: DataFrame, queries: DataFrame, k: int = 3, id_col: str = "doc_key", vec_col: str = "embedding", digits: int = 6) -> DataFrame:
    """As ``vector_top_k``, for stores that aren't shuffled: documents are multiplied where they lie, with questions that are broadcast in parts."""
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema.fields, *docs.schema.fields]}
    rows = docs.where(F.col(vec_col).isNotNull()).select(id_col, vec_col)
    names = ["query_id", id_col, "score"]

    def one_pass(part: pa.Table) -> DataFrame:
        ids = part.column("query_id").combine_chunks()
        shared = docs.sparkSession.sparkContext.broadcast((ids, _matrix(part.column(vec_col).combine_chunks()) if len(ids) else np.empty((0, 0))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = shared.value
            best = Best(len(ids), k, digits)
            for batch in batches:
                for at in range(0, batch.num_rows, SCAN_DOCS):
                    own = batch.slice(at, SCAN_DOCS)
                    theirs = _matrix(own.column(1)).T
                    for q in range(0, len(ids), SCAN_QUERIES):
                        scores = asked[q : q + SCAN_QUERIES] @ theirs
                        if not np.isfinite(scores.sum()):
                            scores[~np.isfinite(scores)] = -np.inf
                        best.offer(q, scores, own.column(0))
            yield from best.rows(ids, names)

        return rows.mapInArrow(run, f"query_id {kinds['query_id']}, `{id_col}` {kinds[id_col]}, score double")

    found = by_passes(queries.where(F.col(vec_col).isNotNull()).select("query_id", vec_col), PASS_QUERIES, one_pass, SCAN)
    return ranked(found.withColumn("score", F.round("score", digits)), ["query_id"], k, [F.desc("score"), F.asc(id_col)])


def mmr(docs: DataFrame, queries: DataFrame, k: int = 3, fetch_k: int = 20, balance: float = 0.5, id_col: str = "doc_key", vec_col: str = "embedding") -> DataFrame:
    """query_id, id, score, rank: greedy picks by balance * likeness to the query - (1 - balance) * likeness to the picks.

    A query's group has fetch_k rows, whatever the tables hold.
    """
    near = vector_top_k(docs, queries, fetch_k, id_col, vec_col)
    rows = near.join(docs.select(id_col, F.col(vec_col).alias("v")), id_col).select("query_id", id_col, "score", "v")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", id_col], ascending=[False, True]).reset_index(drop=True)
        v = np.stack(group["v"].to_numpy()).astype(np.float64)
        relevance, worst, left, out = group["score"].to_numpy(), np.full(len(group), -np.inf), list(range(len(group))), []
        while left and len(out) < k:
            value = [balance * relevance[i] - ((1 - balance) * worst[i] if out else 0) for i in left]
            best = left.pop(int(np.argmax(np.round(value, 9))))
            out.append((best, float(max(value))))
            worst = np.maximum(worst, v @ v[best])
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], id_col: group[id_col].iloc[[i for i, _ in out]].to_numpy(), "score": [s for _, s in out], "rank": range(1, len(out) + 1)})

    return rows.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, {id_col} {kinds[id_col]}, score double, rank int")


def fuse(lists: Sequence[DataFrame], weights: Sequence[float], keys: Sequence[str], text_key: str = "raw_md5", c: int = 60, payload: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Weighted reciprocal-rank fusion of lists with a rank.

    Rows of one ``text_key`` are one result: its scores add up, also within a
    list, and the columns of ``payload`` come from its last row, lists in order.
    Ties go by best rank, then by ``text_key``.
    """
    if len(lists) != len(weights):
        raise ValueError("one weight for each list is needed")
    cols = list(dict.fromkeys([*keys, text_key, *payload]))
    every = None
    for n, (rows, w) in enumerate(zip(lists, weights, strict=True)):
        part = rows.select(*cols, "rank", F.lit(n).alias("list_no"), (F.lit(float(w)) / (F.col("rank") + c)).alias("part"))
        every = part if every is None else every.unionByName(part)
    assert every is not None
    extra = [x for x in payload if x not in (*keys, text_key)]
    picks = [F.max_by(F.col(x), F.struct("list_no", "rank")).alias(x) for x in extra]
    out = every.groupBy(*keys, text_key).agg(F.round(F.sum("part"), digits).alias("score"), F.min("rank").alias("best_rank"), *picks)
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("best_rank"), F.asc(text_key))
    return out.withColumn("rank", F.row_number().over(w))
