"""Sharding by a k-d tree over document metadata.

A node of the tree holds rows and a number of leaves. It is split along its
widest metadata dimension at the weighted median, the weight of a row being its
bytes, until each node is one leaf: ``shards`` leaves, or as many as bring a leaf
to ``target_bytes``. Dimensions are language, source and size. A row's place in
one is the share of all bytes that lie in smaller values, in 4096 steps, so the
dimensions have one scale and any of them can be the widest; names are ordered
by their hash.

All nodes of a level are split together, and nothing but the number of leaves
passes through the driver. The medians are exact: each is found in four rounds
of 13 bits of the sort key, where a round is one map-side combined sum of bytes
by node and bits. A level's cuts, a row a node, are broadcast: at most
``MOST_LEAVES`` rows.

Equal texts have the least places of their copies, and so one sort key: they
stay together as one block up to a twentieth of a leaf's bytes, or those of the
largest document. In larger groups, rows are told apart by a hash of their id,
and a cut can fall into the group: bytes come first.

Defined results: a null text has one byte (its end); null metadata sort first.
Rows that are equal in doc_id and text are one block. Shards can be empty where
there are fewer blocks than leaves. Extra columns are ignored. Empty tables give
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut, text_or_empty

DIMS = ("lang", "source", "size")
#: Bits of a sort key: the place in the dimension, the text's hash, the row's.
PLACE_BITS, TEXT_BITS, ROW_BITS = 12, 24, 16
TIE_BITS = TEXT_BITS + ROW_BITS
#: Bits that a round settles.
STEP = 13
PLACES = 1 << PLACE_BITS
#: Leaves at most, as a level's cuts are broadcast.
MOST_LEAVES = 1 << 20
#: A group of equal texts up to this share of a leaf stays together.
TOGETHER = 1 / 20
#: Rows of a slot bucket.
BUCKET_ROWS = 20_000


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, text_key, and a bin for each dimension: one row a document, without its text."""
    text = text_or_empty()
    nothing = F.lit(None).cast("string")
    own = docs.select("doc_id", "text", *[(F.col(c).cast("string") if c in docs.columns else nothing).alias(c) for c in DIMS[:2]])
    size = F.octet_length(text).cast("long") + 1
    name = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(F.col(c)), F.lit(PLACES - 1))).cast("int")
    by_size = F.least(F.lit(PLACES - 1), F.floor(F.log2(size.cast("double")) * (PLACES // 64))).cast("int")
    return own.select("doc_id", size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_key"), F.array(name("lang"), name("source"), by_size).alias("bins"))


def _placed(rows: DataFrame, together: Column) -> DataFrame:
    """Adds tie and dims, the places in the dimensions; ``together`` is the bytes up to which equal texts are one block."""
    bins = rows.select("size", F.posexplode("bins").alias("dim", "bin")).groupBy("dim", "bin").agg(F.sum("size").alias("b"))
    order = Window.partitionBy("dim").orderBy("bin")  # at most PLACES rows
    middle = (F.sum("b").over(order) - F.col("b") / 2) / F.sum("b").over(Window.partitionBy("dim"))
    places = bins.select("dim", "bin", F.floor(middle * (PLACES - 1)).cast("long").alias("place"))
    for i in range(len(DIMS)):
        own = F.broadcast(places.where(F.col("dim") == i).select(F.col("bin").alias("b"), F.col("place").alias(f"p{i}")))
        rows = rows.join(own, F.element_at("bins", i + 1) == F.col("b")).drop("b")
    group = rows.groupBy("text_key").agg(F.sum("size").alias("group_bytes"), *[F.min(f"p{i}").alias(f"g{i}") for i in range(len(DIMS))])
    apart = F.when(F.col("group_bytes") <= together, F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(1 << ROW_BITS)))
    tie = F.shiftleft(F.pmod("text_key", F.lit(1 << TEXT_BITS)), ROW_BITS) + apart
    return rows.join(group, "text_key").select("doc_id", "size", "text_crc32", tie.alias("tie"), F.array(*[f"g{i}" for i in range(len(DIMS))]).alias("dims"))


def _key(dim: Column) -> Column:
    return F.shiftleft(F.element_at("dims", dim + 1), TIE_BITS) + F.col("tie")


def _plan(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, dim (the widest, the first of equals), want (bytes of the left side) of nodes that have several leaves."""
    place = lambda i: F.element_at("dims", i + 1)
    stats = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *[(F.max(place(i)) - F.min(place(i))).alias(f"width{i}") for i in range(len(DIMS))])
    widths = [F.col(f"width{i}") for i in range(len(DIMS))]
    widest = F.coalesce(*[F.when(w == F.greatest(*widths), F.lit(i)) for i, w in enumerate(widths)])
    return stats.join(F.broadcast(nodes.where("leaves > 1")), "node").select("node", widest.alias("dim"), (F.col("bytes") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("want"))


def _cuts(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """node, dim, first: the first key of the right side of each node."""
    keyed = rows.join(F.broadcast(plan.select("node", "dim")), "node").select("node", "size", _key(F.col("dim")).alias("key"))
    state = plan.select("node", "dim", "want", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("left"))
    by_bin = Window.partitionBy("node").orderBy("bin")
    for done in range(0, PLACE_BITS + TIE_BITS, STEP):
        shift = PLACE_BITS + TIE_BITS - done - STEP
        inside = keyed.join(F.broadcast(state), "node").where(F.shiftrightunsigned("key", shift + STEP) == F.col("prefix"))
        bits = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit((1 << STEP) - 1))
        sums = inside.groupBy("node", "dim", "want", "prefix", "left", bits.alias("bin")).agg(F.sum("size").alias("b"))
        upto = sums.withColumn("upto", F.col("left") + F.sum("b").over(by_bin)).withColumn("last", F.max("bin").over(Window.partitionBy("node")))
        over = upto.where((F.col("upto") > F.col("want")) | (F.col("bin") == F.col("last"))).withColumn("n", F.row_number().over(by_bin)).where("n = 1")
        state = over.select("node", "dim", "want", (F.shiftleft("prefix", STEP) + F.col("bin")).alias("prefix"), (F.col("upto") - F.col("b")).alias("left"), "b")
    # one block of equal keys is left: it goes to the side that is nearer
    return state.select("node", "dim", (F.col("prefix") + (F.col("left") + F.col("b") / 2 <= F.col("want")).cast("int")).alias("first"))


def shard_by_kd_tree(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard int, slot long (gapless from 0 in each shard).

    ``target_bytes`` takes the place of ``shards``: as many leaves as hold so many bytes each.
    """
    rows = cut(_rows(docs))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.coalesce(F.max("size"), F.lit(0)).alias("most")).first()
    if target_bytes:
        shards = max(1, -(-int(total["b"]) // target_bytes))
    if shards > MOST_LEAVES:
        raise ValueError(f"{shards} shards are over {MOST_LEAVES}")
    together = max(float(total["most"]), total["b"] / shards * TOGETHER)
    rows = cut(_placed(rows, F.lit(together))).withColumn("node", F.lit(0).cast("long"))
    spark = rows.sparkSession
    nodes = spark.range(1).select(F.col("id").alias("node"), F.lit(shards).cast("long").alias("leaves"), F.lit(0).cast("long").alias("shard"))
    for _ in range(math.ceil(math.log2(shards))):
        cuts = F.broadcast(cut(_cuts(rows, cut(_plan(rows, nodes)))))
        right = (F.col("first").isNotNull() & (_key(F.col("dim")) >= F.col("first"))).cast("long")
        rows = rows.join(cuts, "node", "left").withColumn("node", F.col("node") * 2 + right).drop("dim", "first")
        half = F.floor(F.col("leaves") / 2)
        side = lambda n, leaves, first: F.struct(n.alias("node"), leaves.alias("leaves"), first.alias("shard"))
        both = F.array(side(F.col("node") * 2, half, F.col("shard")), side(F.col("node") * 2 + 1, F.col("leaves") - half, F.col("shard") + half))
        one = F.array(side(F.col("node") * 2, F.col("leaves"), F.col("shard")))
        nodes = nodes.select(F.explode(F.when(F.col("leaves") > 1, both).otherwise(one)).alias("x")).select("x.*")
    placed = rows.join(F.broadcast(nodes.select("node", F.col("shard").cast("int").alias("shard"))), "node").drop("node", "dims")
    return _slots(cut(placed), shards)


def _slots(placed: DataFrame, shards: int) -> DataFrame:
    """Numbers the rows of each shard in buckets of a bounded size, and adds what stands before a bucket."""
    buckets = max(1, placed.count() // (shards * BUCKET_ROWS))
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "tie"))
    out = dealt.withColumn("rank", rank).join(offsets, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))
