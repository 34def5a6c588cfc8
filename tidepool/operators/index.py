"""A stored inverted index with block bounds.

Rows are indexed where they lie, some hundred at a time: such a block holds, for
each token in it, the rows that have it, how often, and their lengths, with the
greatest count and the least length of all. So building shuffles nothing, a token
that every row has is spread over all blocks, and new rows are added as blocks of
their own. Statistics are sums over blocks: how many rows, their lengths, and by
token how many rows hold it.

A search reads the directory first (token, block and bounds, without the lists):
what a block can add to a question's score is bounded by its greatest count and
least length, whatever the statistics are by then. The blocks that hold the
weightiest of its tokens are scored first; their kth score is the least that any
other block must be able to reach to be read. Scores are those of ``search.bm25_scores``.

With group columns statistics and results are those of each group alone.

Without them a block is stored as one row, and a search shuffles neither blocks nor questions:
these are broadcast in parts of bounded size, each part is a pass over the blocks, and of a
block's lists those that are asked for are multiplied with the questions' weights. No posting
becomes a row, and a task gives exactly the k best of its rows for each question (``best``).
"""

from __future__ import annotations

import copy
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.checkpoint import cut, settings
from tidepool.operators.best import Best, by_passes

#: Rows of a block.
BLOCK_ROWS = 512
#: Tables that are counted to have at most so many rows are broadcast.
BROADCAST_ROWS = 200_000
#: Questions of a pass at most, on average; blocks that a worker gets at once; questions whose scores over a block are held at once; products that are held at once.
TILE_QUERIES, TILE_BLOCKS, HELD_QUERIES, HELD_PRODUCTS = 16_384, 32, 2_048, 1 << 21
#: A token is multiplied as a dense row from this share of all products of questions and rows on.
DENSE = 1 / 600
#: Rows and bytes of a batch that a worker indexes at once, so its memory doesn't grow with the table.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(4 * BLOCK_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: A search reads whole blocks, so a task gets few of them at once.
SCAN = BATCH | {"spark.sql.execution.arrow.maxRecordsPerBatch": str(TILE_BLOCKS), "spark.sql.parquet.columnarReaderBatchSize": str(TILE_BLOCKS)}
#: A block as one row, the lists of its tokens one behind the other; known: rows whose tokens aren't null.
_PACKED = "block long, n long, known long, total long, tokens array<string>, held array<int>, most array<int>, least array<int>, places array<int>, counts array<int>, lengths array<int>"
_LISTS = "block long, token string, n long, most int, least int, total long, places array<int>, counts array<int>, lengths array<int>"


def _block(tokens: pa.Array) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """(tokens, columns) of the lists of some rows, a list a token, rows by their place."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(tokens.flatten())
    rows = len(tokens)
    pairs, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * rows + np.repeat(np.arange(rows), sizes), return_counts=True)
    code, place = pairs // max(rows, 1), pairs % max(rows, 1)
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    length = sizes[place]
    cols = {"starts": starts, "places": place, "counts": tf, "lengths": length}
    if len(starts):
        cols |= {"n": np.diff(np.append(starts, len(code))), "most": np.maximum.reduceat(tf, starts), "least": np.minimum.reduceat(length, starts)}
    else:
        cols |= dict.fromkeys(("n", "most", "least"), np.empty(0, np.int64))
    return coded.dictionary.take(pa.array(code[starts])), cols


def _indexer(groups: int, kinds: list[pa.DataType], first: int):
    """Batches of (group columns, key, tokens) to rows of lists, and one row without a token for each block, with its rows' keys; without group columns to a row a block.

    Blocks are numbered within their task; the tasks are numbered from first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (first + (TaskContext.get().partitionId() if TaskContext.get() else 0)) << 32
        for batch in batches:
            # rows of like length stand together, so a block's greatest count and least length are near each other
            sizes = pc.fill_null(pc.list_value_length(batch.column(groups + 1)), 0)
            batch = batch.take(pa.array(np.argsort(sizes.to_numpy(zero_copy_only=False), kind="stable")))
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                by: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(*[c.to_pylist() for c in part.columns[:groups]], strict=True) if groups else [()] * part.num_rows):
                    by.setdefault(key, []).append(i)
                for key, at_rows in by.items():
                    own = part.take(pa.array(at_rows)) if groups else part
                    tokens, c = _block(own.column(groups + 1))
                    m = len(tokens) + 1
                    known = own.num_rows - own.column(groups + 1).null_count
                    size = int(pc.sum(pc.list_value_length(own.column(groups + 1))).as_py() or 0)
                    if not groups:
                        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                        cols = [pa.array([x], pa.int64()) for x in (number, own.num_rows, known, size)] + [one(tokens, tokens.type)]
                        cols += [one(c[x].astype(np.int32), pa.int32()) for x in ("n", "most", "least", "places", "counts", "lengths")]
                        yield pa.RecordBatch.from_arrays([*cols, one(own.column(0), kinds[0])], names=["block", "n", "known", "total", "tokens", "held", "most", "least", "places", "counts", "lengths", "keys"])
                        number += 1
                        continue
                    ends = np.append(c["starts"], len(c["places"])).astype(np.int32)
                    lists = [pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1])), pa.array(c[x].astype(np.int32))) for x in ("places", "counts", "lengths")]
                    ints = lambda x, last, kind: pa.array(np.append(c[x], last), kind)  # noqa: B023, E731
                    keys = pa.concat_arrays([pa.nulls(m - 1, pa.list_(kinds[groups])), pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), own.column(groups))])
                    cols = [pa.array([k] * m, t) for k, t in zip(key, kinds[:groups], strict=True)]
                    cols += [pa.array(np.full(m, number)), pa.concat_arrays([tokens, pa.nulls(1, tokens.type)]), ints("n", own.num_rows, pa.int64()), ints("most", known, pa.int32()), ints("least", 0, pa.int32()), pa.array(np.append(np.zeros(m - 1, np.int64), size)), *lists, keys]
                    yield pa.RecordBatch.from_arrays(cols, names=[*(f"g{i}" for i in range(groups)), "block", "token", "n", "most", "least", "total", "places", "counts", "lengths", "keys"])
                    number += 1

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """blocks: group columns, block, token, n, most, least, total, places, counts, lengths, keys; terms: group columns, token, df, idf; sizes: group columns, n, avgdl.

    packed: without group columns the blocks as they are stored.
    """

    blocks: DataFrame
    terms: DataFrame
    sizes: DataFrame
    group: tuple[str, ...]
    key: str
    packed: DataFrame | None = None


def _unpacked(packed: DataFrame) -> DataFrame:
    """Rows of lists, and one without a token for each block, of blocks that are stored as one row."""
    # a list begins where those before it end
    before = F.transform(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.aggregate(F.slice("held", 1, i), F.lit(0), lambda x, y: x + y))
    own = lambda x: [F.slice(c, x["before"] + 1, x["held"]).alias(c) for c in ("places", "counts", "lengths")]
    each = F.transform(F.arrays_zip("tokens", "held", "most", "least", "before"), lambda x: F.struct(x["tokens"].alias("token"), x["held"].cast("long").alias("n"), x["most"].alias("most"), x["least"].alias("least"), *own(x)))
    lists = packed.where(F.size("held") > 0).withColumn("before", before).select("block", F.explode(each).alias("x"))
    heads = packed.select("block", F.lit(None).cast("string").alias("token"), "n", F.col("known").cast("int").alias("most"), F.lit(0).alias("least"), "total", "keys")
    return lists.select("block", "x.*").unionByName(heads, allowMissingColumns=True)


def build(rows: DataFrame, path: str, key: str = "doc_key", group: Sequence[str] = (), mode: str = "overwrite", epsilon: float = 0.25) -> LexicalIndex:
    """Indexes group columns, key and tokens of rows in a folder that all executors share; mode="append" adds rows to it."""
    from pyspark.sql.pandas.types import to_arrow_type

    own = rows.select(*group, F.col(key).alias("key"), "tokens")
    names = {f.name: f.dataType for f in own.schema.fields}
    kinds = [to_arrow_type(names[c]) for c in (*group, "key")]
    ddl = "".join(f"{c} {names[c].simpleString()}, " for c in group) + (_LISTS if group else _PACKED) + f", keys array<{names['key'].simpleString()}>"
    last = rows.sparkSession.read.parquet(f"{path}/blocks").agg(F.max("block")).first()[0] if mode == "append" else None
    first = 0 if last is None else (last >> 32) + 1
    with settings(rows.sparkSession, BATCH):
        own.mapInArrow(_indexer(len(group), kinds, first), ddl).write.mode(mode).parquet(f"{path}/blocks")
    return refresh(rows.sparkSession, path, key, group, epsilon)


def refresh(spark: SparkSession, path: str, key: str = "doc_key", group: Sequence[str] = (), epsilon: float = 0.25) -> LexicalIndex:
    """Sums up the blocks' statistics anew, without their lists."""
    g = list(group)
    blocks = spark.read.parquet(f"{path}/blocks")
    if g:
        sizes = blocks.where("token is null").groupBy(*g).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("most")).alias("avgdl"))
        df = blocks.where("token is not null").groupBy(*g, "token").agg(F.sum("n").alias("df"))
        raw = df.join(F.broadcast(sizes), g)
    else:
        sizes = blocks.groupBy().agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("known")).alias("avgdl"))
        df = blocks.select(F.explode(F.arrays_zip("tokens", "held")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.held").alias("df"))
        raw = df.withColumn("n", F.lit(next((r["n"] for r in sizes.collect()), None)).cast("long"))  # sizes is one row
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).select(*g, "token", "df", "raw")
    with settings(spark, {} if g else SCAN):
        raw.write.mode("overwrite").parquet(f"{path}/terms")
    stored = spark.read.parquet(f"{path}/terms")
    means = stored.groupBy(*g).agg(F.avg("raw").alias("mean_idf"))
    if g:
        sizes = sizes.join(means, g, "left")
    else:
        sizes = sizes.withColumn("mean_idf", F.lit(means.first()[0]).cast("double"))
    sizes.write.mode("overwrite").parquet(f"{path}/sizes")
    return open_index(spark, path, key, group, epsilon)


def open_index(spark: SparkSession, path: str, key: str = "doc_key", group: Sequence[str] = (), epsilon: float = 0.25) -> LexicalIndex:
    g = list(group)
    sizes = spark.read.parquet(f"{path}/sizes")
    terms = spark.read.parquet(f"{path}/terms")
    terms = terms.join(sizes.select(*g, "mean_idf"), g) if g else terms.withColumn("mean_idf", F.lit(next((r["mean_idf"] for r in sizes.collect()), None)).cast("double"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    blocks = spark.read.parquet(f"{path}/blocks")
    return LexicalIndex(blocks if g else _unpacked(blocks), terms.select(*g, "token", "df", idf.alias("idf")), sizes.select(*g, "n", "avgdl"), tuple(group), key, None if g else blocks)


@dataclass(frozen=True)
class Plan:
    """What a search reads. weights: query_id, group columns, token, w, avgdl; bounds: query_id, group columns, block, bound, held (weights of its tokens), lists; wanted: those that can hold a result."""

    weights: DataFrame
    bounds: DataFrame
    wanted: DataFrame


def _part(tf, length, k1: float, b: float):
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.col("avgdl")))


def plan(index: LexicalIndex, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> Plan:
    """Chooses the blocks of each question. queries: query_id, tokens and, if a query is for one group only, the group columns."""
    g = list(index.group)
    asked_of = [c for c in g if c in queries.columns]
    asked = queries.select(*asked_of, "query_id", F.explode("tokens").alias("token")).groupBy(*asked_of, "query_id", "token").agg(F.count("*").alias("qtf"))
    sizes = index.sizes if g else index.sizes.collect()  # without groups one row
    rows = asked.count() * (1 if asked_of == g else index.sizes.count())
    hint = F.broadcast if rows <= BROADCAST_ROWS else lambda df: df  # asked and weights have at most so many rows
    known = index.terms.join(hint(asked), [*asked_of, "token"])
    known = known.join(F.broadcast(sizes), g) if g else known.withColumn("avgdl", F.lit(sizes[0]["avgdl"] if sizes else None).cast("double"))
    weights = hint(known.select("query_id", *g, "token", (F.col("qtf") * F.col("idf")).alias("w"), "avgdl"))
    directory = index.blocks.where("token is not null").select(*g, "block", "token", "most", "least")
    least = F.greatest(F.lit(0.0), F.col("w")) * _part(F.col("most"), F.col("least"), k1, b)
    bounds = cut(directory.join(weights, [*g, "token"]).groupBy("query_id", *g, "block").agg(F.sum(least).alias("bound"), F.sum("w").alias("held"), F.count("*").alias("lists")))
    of_query = Window.partitionBy("query_id", *g)
    seeds = bounds.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("held"), F.desc("bound"), "block"))).where(F.col("place") <= 2 * k).select("query_id", *g, "block")
    found = _scores(index, weights, seeds, k1, b, digits)
    floors = found.withColumn("place", F.row_number().over(of_query.orderBy(F.desc("score")))).where(F.col("place") == k).select("query_id", *g, F.col("score").alias("floor"))
    slack = 10.0**-digits  # bounds and scores are rounded sums
    wanted = bounds.join(hint(floors), ["query_id", *g], "left").where(F.col("floor").isNull() | (F.col("bound") + slack >= F.col("floor")))
    return Plan(weights, bounds, cut(wanted.select("query_id", *g, "block")))


def _scores(index: LexicalIndex, weights: DataFrame, wanted: DataFrame, k1: float, b: float, digits: int) -> DataFrame:
    """query_id, group columns, block, place, score of the wanted blocks' rows. A block's lists lie together, so sums are made before the shuffle."""
    g = list(index.group)
    own = index.blocks.where("token is not null").join(weights, [*g, "token"]).join(wanted, ["query_id", *g, "block"], "left_semi")
    post = own.select("query_id", *g, "block", "w", "avgdl", F.explode(F.arrays_zip("places", "counts", "lengths")).alias("x"))
    part = F.col("w") * _part(F.col("x.counts"), F.col("x.lengths"), k1, b)
    return post.groupBy("query_id", *g, "block", F.col("x.places").alias("place")).agg(F.round(F.sum(part), digits).alias("score"))


class _Asked:
    """Questions of a tile by token: the numbers of those that hold one, and their weights."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, tokens: int):
        order = np.argsort(codes, kind="stable")
        self.n, self.owner, self.weight = n, owner[order].astype(np.int32), weight[order]
        self.held = np.bincount(codes, minlength=tokens)
        self.first = np.cumsum(self.held) - self.held

    def dense(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, len(codes)))
        for j, t in enumerate(codes.tolist()):
            own = slice(self.first[t], self.first[t] + self.held[t])
            out[self.owner[own], j] = self.weight[own]
        return out

    def add(self, scores: np.ndarray, code: np.ndarray, place: np.ndarray, part: np.ndarray) -> None:
        """Adds weight times part to each question that holds the token code, in slices."""
        n = self.held[code]
        ends = np.cumsum(n)
        at = 0
        while at < len(code):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_PRODUCTS, side="right")))
            m = n[at:to]
            own = np.arange(int(m.sum()), dtype=np.int32) + np.repeat((self.first[code[at:to]] - (np.cumsum(m) - m)).astype(np.int32), m)
            cell = self.owner[own] * scores.shape[1] + np.repeat(place[at:to], m)
            product = self.weight[own] * np.repeat(part[at:to], m)
            if len(cell) * 16 > scores.size:
                scores += np.bincount(cell, product, scores.size).reshape(scores.shape)
            else:
                np.add.at(scores.reshape(-1), cell, product)
            at = to


class _Part:
    """A pass's questions: their tokens by number, and in slices of HELD_QUERIES who asks for which with what weight."""

    def __init__(self, asked: pa.Table, n: int):
        asked = asked.combine_chunks()
        self.ids = pa.concat_arrays(asked.column("query_id").chunks) if asked.num_rows else pa.array([], asked.column("query_id").type)
        x = pc.list_flatten(asked.column("x")).combine_chunks() if asked.num_rows else pa.array([], asked.schema.field("x").type.value_type)
        token = pc.dictionary_encode(x.field("token"))
        self.tokens, codes = token.dictionary, token.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        weight, df = x.field("w").to_numpy(zero_copy_only=False), np.zeros(len(self.tokens))
        df[codes] = x.field("df").to_numpy(zero_copy_only=False)
        owner = pc.list_parent_indices(asked.column("x")).to_numpy() if asked.num_rows else np.empty(0, np.int64)
        self.positive = bool((weight > 0).all())
        self.slices = []
        for at in range(0, len(self.ids), HELD_QUERIES):
            own = slice(*np.searchsorted(owner, [at, at + HELD_QUERIES]))
            self.slices.append(_Asked(codes[own], owner[own].astype(np.int64) - at, weight[own], min(HELD_QUERIES, len(self.ids) - at), len(self.tokens)))
        held = np.bincount(codes, minlength=len(self.tokens))
        self.common = np.flatnonzero(held * df >= DENSE * max(1, len(self.ids)) * n)


def _scanner(shared, k: int, k1: float, b: float, avgdl: float, digits: int, names: list[str]):
    """Blocks to query_id, key, score: of each question the k best rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: _Part = shared.value
        tokens, common, slices = part.tokens, part.common, part.slices
        row_of = np.full(len(tokens), -1)
        row_of[common] = np.arange(len(common))
        dense_weights = [s.dense(common) for s in slices]
        firsts = np.cumsum([0, *(s.n for s in slices)])
        best = Best(len(part.ids), k, digits, np.nextafter(0.0, 1.0) if part.positive else -np.finfo(float).max)
        for batch in batches:
            codes = pc.fill_null(pc.index_in(pc.list_flatten(batch.column("tokens")), tokens), -1).to_numpy()
            held = pc.list_flatten(batch.column("held")).to_numpy()
            code = np.repeat(codes, held).astype(np.int64)
            known = code >= 0
            place, tf, length = (pc.list_flatten(batch.column(c)).to_numpy() for c in ("places", "counts", "lengths"))
            ends = np.append(0, np.cumsum(pc.list_value_length(batch.column("places")).to_numpy()))
            for i in range(batch.num_rows):
                keys = batch.column("keys")[i].values
                at = slice(ends[i], ends[i + 1])
                own = known[at]
                c, p, f, dl = (x[at][own] for x in (code, place, tf, length))
                if not len(c):
                    continue
                part_of = f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))
                row = row_of[c]
                dense = row >= 0
                table = np.zeros((len(common), len(keys)))
                table[row[dense], p[dense]] = part_of[dense]
                for s, weights, first in zip(slices, dense_weights, firsts, strict=False):
                    scores = weights @ table
                    rare = ~dense & (s.held[c] > 0)
                    s.add(scores, c[rare], p[rare], part_of[rare])
                    if not part.positive:  # else rows that share no token are those of score 0
                        plain = copy.copy(s)
                        plain.weight = np.ones(len(s.weight))
                        both = np.zeros_like(scores)
                        plain.add(both, c, p, np.ones(len(c)))
                        scores[both == 0] = -np.inf
                    best.offer(int(first), scores, keys)
        yield from best.rows(part.ids, names)

    return run


def _scanned(index: LexicalIndex, queries: DataFrame, k: int, k1: float, b: float, digits: int) -> DataFrame:
    """query_id, key, score: of each question the k best of each task's rows."""
    spark = queries.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{index.key}` {index.packed.schema['keys'].dataType.elementType.simpleString()}, score double"
    sizes = index.sizes.collect()  # one row
    if not sizes or not sizes[0]["avgdl"]:
        return spark.createDataFrame([], schema)
    asked = queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qtf"))
    known = index.terms.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, "token")
    weighed = cut(known.groupBy("query_id").agg(F.collect_list(F.struct("token", (F.col("qtf") * F.col("idf")).alias("w"), "df")).alias("x")))
    blocks = index.packed.select("tokens", "held", "places", "counts", "lengths", "keys")

    def one_pass(part: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast(_Part(part, int(sizes[0]["n"])))
        return blocks.mapInArrow(_scanner(shared, k, k1, b, float(sizes[0]["avgdl"]), digits, ["query_id", index.key, "score"]), schema)

    return by_passes(weighed, TILE_QUERIES, one_pass, SCAN)


def search(index: LexicalIndex, queries: DataFrame, k: int = 3, k1: float = 1.5, b: float = 0.75, digits: int = 6) -> DataFrame:
    """query_id, group columns, key, score, rank: the k best by rounded score and then by key."""
    g = list(index.group)
    by = Window.partitionBy("query_id", *g)
    best = by.orderBy(F.desc("score"), F.asc(index.key))
    if not g:
        scores = _scanned(index, queries, k, k1, b, digits).withColumn("score", F.round("score", digits))
        return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    p = plan(index, queries, k, k1, b, digits)
    scores = _scores(index, p.weights, p.wanted, k1, b, digits)
    tied = scores.withColumn("r", F.rank().over(by.orderBy(F.desc("score")))).where(F.col("r") <= k).drop("r")
    keys = index.blocks.where("token is null").select(*g, "block", "keys")
    named = tied.join(keys, [*g, "block"]).select("query_id", *g, F.col("keys")[F.col("place")].alias(index.key), "score")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
