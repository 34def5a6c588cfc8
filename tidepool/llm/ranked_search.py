"""Ranked lexical search by a threshold-seeded join over stored impacts.

One pass splits documents into terms and stores a row for each asked term of a
document. With the counts of the whole table known, a posting's impact is what
it adds to a score. Each term stores its k highest impacts and their documents.
A term's kth impact is a lower bound of an item's kth score; those documents,
scored exactly, give a higher one: the item's threshold. The item's terms stand
by falling highest impact, and the sum of what follows bounds what the rest can
add: a tail of terms that can't reach the threshold together generates no
candidates, and a candidate whose generated part and tail fall short of it is
dropped. The others are scored exactly over all terms.

No document is left out that could be among the k best: the threshold is the kth
score of real documents, and both bounds are sums of highest impacts. Scores are
64-bit integers, so nothing is rounded away.

Only tables with a counted bound of ``BROADCAST_ROWS`` rows are broadcast; larger
ones are joined by shuffle. A term's list is never gathered in one task, but for
its k highest impacts, which are cut in each task first.

Defined results: a null text has no terms; a null item_id takes no part, and rows
that repeat an item_id are one item with the terms of all of them. Every row of
docs counts as a document of its own, repeated ids and texts too; of equal scores
the smaller doc_id goes first, a null one last, and equal ids take ranks in any
order, which no column shows. Very long texts are split whole, in their task.
Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut

#: Tables of more rows are not broadcast.
BROADCAST_ROWS = 200_000
#: Bytes to what they count as: letters and digits of ASCII in lower case and all beyond ASCII stay, the rest parts terms.
TERM_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
ROWS = "row long, id long, n long, term string, tf long"


def term_rows(rows: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """row, id, n, term, tf: a row for each term of a text, and for each text with terms one row whose term begins with NUL, so is none.

    row numbers the texts; n counts a text's terms with repeats, tf those of one term.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[], [], [], [], []]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = text.encode().translate(TERM_BYTES).split() if text else []
                    if words:
                        tf = Counter(words)
                        m = len(tf) + 1
                        own = ([row] * m, [key] * m, [len(words)] * m, [b"\0%d" % row, *tf], [0, *tf.values()])
                        for col, more in zip(cols, own, strict=True):
                            col += more
                    row += 1
                arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
                arrays[3] = arrays[3].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "id", "n", "term", "tf"])

    return rows.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, ROWS)


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Marked for a broadcast if it is counted to be small; ``df`` should be cheap to count."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _exact(postings: DataFrame, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """item_id, row, doc_id, score over all terms of the item, of pairs (item_id, row)."""
    wanted = _small(pairs.select("row").distinct())
    near = postings.join(wanted, "row", "left_semi").join(pairs, "row")
    return near.join(asked.select("item_id", "t"), ["item_id", "t"], "left_semi").groupBy("item_id", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("impact").alias("score"))


def _best(rows: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _floor(postings: DataFrame, seeds: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """item_id, floor: the kth of the exact scores of an item's 4 * k seeds with the largest parts; no row for an item of fewer seeds."""
    some = cut(_best(seeds, ["item_id"], 4 * k, F.desc("part"), F.asc("row")).select("item_id", "row"))
    scored = _best(_exact(postings, some, asked), ["item_id"], k, F.desc("score"), F.asc("row"))
    return cut(scored.where(F.col("rank") == k).select("item_id", F.col("score").alias("floor")))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_col: str = "item_id", doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank int from 1, doc_id long, score long: the k documents of the highest scores above 0 for each item."""
    of_item = cut(term_rows(items, item_col, text_col).where("id is not null and not startswith(term, '\\0')").select(F.col("id").alias("item_id"), "term").distinct())
    terms = cut(of_item.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    terms = _small(terms)
    of_item = of_item.join(terms, "term").select("item_id", "t")

    rows = term_rows(docs, doc_col, text_col).join(terms, "term", "left").where("t is not null or startswith(term, '\\0')")
    rows = cut(rows.select("row", F.col("id").alias("doc_id"), "n", "t", "tf"))
    count, length = rows.where("t is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    rows = rows.where("t is not null")

    weight = F.floor(1000 * F.log((2 * F.lit(float(count)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = cut(rows.groupBy("t").agg(F.count("*").alias("df")).select("t", weight.alias("w")).where("w > 0"))
    m = F.expr(f"10 + (90L * n * {count}L) div {length}L")
    postings = rows.withColumn("m", m).join(_small(weights), "t").select("t", "row", "doc_id", "m", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("impact")).where("impact > 0")

    # what a term can add at most, by size class of documents: long ones are never as dense as short ones
    postings = postings.withColumn("size", F.floor(F.log2("m")).cast("int"))
    stored = cut(_best(postings, ["t"], k, F.desc("impact"), F.asc_nulls_last("doc_id"), F.asc("row")))
    bounds = cut(of_item.join(_small(postings.groupBy("t", "size").agg(F.max("impact").alias("most"))), "t"))

    # seeds: the stored documents that add up to most, scored exactly
    seeds = stored.join(_small(of_item), "t").groupBy("item_id", "row").agg(F.sum("impact").alias("part"))
    floor = _floor(postings, seeds, of_item, k)

    # only terms whose suffix can reach the floor generate; what the others could add is the tail
    ahead = Window.partitionBy("item_id", "size").orderBy(F.desc("most"), "t").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    asked = bounds.join(_small(floor), "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(1))).withColumn("suffix", F.sum("most").over(ahead))
    tail = F.max(F.when(F.col("suffix") < F.col("floor"), F.col("suffix"))).over(Window.partitionBy("item_id", "size"))
    asked = asked.withColumn("tail", F.coalesce(tail, F.lit(0))).where("suffix >= floor")
    own = cut(asked.select("item_id", "t", "size", "floor", "tail", (F.col("floor") - F.col("suffix") + F.col("most")).alias("need")))
    made = postings.join(_small(own), ["t", "size"]).groupBy("item_id", "row").agg(F.sum("impact").alias("part"), F.bool_or(F.col("impact") >= F.col("need")).alias("opens"), F.first("floor").alias("floor"), F.first("tail").alias("tail"))
    candidates = cut(made.where("opens and part + tail >= floor").select("item_id", "row", "part", "tail"))
    # what was generated names better seeds
    floor = _floor(postings, candidates, of_item, k)
    candidates = cut(candidates.join(_small(floor), "item_id", "left").where("floor is null or part + tail >= floor").select("item_id", "row"))
    final = _best(_exact(postings, candidates, of_item), ["item_id"], k, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    return final.select("item_id", "rank", "doc_id", "score")
