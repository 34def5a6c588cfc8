"""A value index: bitmaps of row numbers by (column, value), and predicate trees answered by bit operations.

Rows get numbers and are stored bucketed by runs of 32,768 of them, which one bitmap
covers. A column of at most ``MOST_VALUES`` distinct values has a bitmap for each; the
others are cut into ``BINS`` ranges of values, each with its least and greatest value. A
term finds two bitmaps a run: rows that match for sure, and rows that may, which are more
only where a range is cut by the term. AND and OR are bitmap aggregates over their parts,
run by run, so no row is read before the tree is answered; then the runs that hold results
are, and only rows that may match are compared. A term on a column without an index may
match every row.

Defined results: those of ``filters.apply_filter`` over the same rows. Nulls are in no
bitmap. Repeated rows have numbers of their own. Columns whose names begin with ``__``
are the index's. Values order as Spark orders them, NaN last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.checkpoint import cut
from tidepool.operators.filters import COMPARE, compile_filter
from tidepool.sources.files import read_store, write_store
from tidepool.sources.stores import read_bucketed, write_bucketed

MOST_VALUES, BINS = 256, 64
RUN_BYTES = 4096
#: Up to so many runs are looked up in their buckets, beyond that the stored rows are read through.
FEW_RUNS = 1000


@dataclass(frozen=True)
class ValueIndex:
    """rows: the table with __run and __bit. values: for each indexed column (run, lo, hi, bits)."""

    rows: DataFrame
    values: Mapping[str, DataFrame]


def _bits(byte: str) -> Column:
    return F.unhex(F.repeat(F.lit(byte), F.lit(RUN_BYTES)))


def _ranges(rows: DataFrame, name: str) -> Column | None:
    """The number of a value's range; None if every value has a bitmap of its own.

    Distinct values are dealt out by range, so a hot value weighs no more than another,
    and the greatest of each part, BINS at most, bounds a range.
    """
    distinct = rows.where(F.col(name).isNotNull()).select(F.col(name).alias("v")).distinct()
    if distinct.limit(MOST_VALUES + 1).count() <= MOST_VALUES:
        return None
    parts = distinct.repartitionByRange(BINS, "v").groupBy(F.spark_partition_id().alias("part")).agg(F.max("v").alias("top"))
    tops = sorted(r["top"] for r in parts.collect())
    return reduce(lambda a, b: a + b, [(F.col(name) > F.lit(t)).cast("int") for t in tops[:-1]], F.lit(0))


def build(rows: DataFrame, folder: str, columns: Sequence[str]) -> ValueIndex:
    """Stores the rows and the bitmaps of some columns in a folder that all executors share."""
    spark = rows.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = cut(rows.withColumn("__row", F.monotonically_increasing_id()))  # numbers stay as they are from here on
    runs = numbered.withColumn("__run", F.bitmap_bucket_number("__row")).withColumn("__bit", F.bitmap_bit_position("__row").cast("int")).drop("__row")
    kept = write_bucketed(runs, f"{folder}/rows", "__run", buckets)
    for i, name in enumerate(columns):
        part = _ranges(kept, name)
        held = kept.where(F.col(name).isNotNull()).select("__run", "__bit", F.col(name).alias("v"), (F.col(name) if part is None else part).alias("p"))
        # bits and bounds of each task's rows are put together before anything is shuffled
        bits = held.groupBy("p", "__run").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bitmap_construct_agg(F.col("__bit").cast("long")).alias("bits"))
        write_store(bits.select("__run", "lo", "hi", "bits"), f"{folder}/values_{i}")
    write_store(spark.createDataFrame([(i, c, buckets) for i, c in enumerate(columns)], "i int, name string, buckets int"), f"{folder}/columns")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> ValueIndex:
    """The index in a folder, also in a session that did not build it."""
    named = read_store(spark, f"{folder}/columns").orderBy("i").collect()
    rows = read_bucketed(spark, f"{folder}/rows", "__run", named[0]["buckets"])
    return ValueIndex(rows, {r["name"]: read_store(spark, f"{folder}/values_{r['i']}") for r in named})


def _bounds(op: str, value: object) -> tuple[Column, Column]:
    """(all, some) of the values from lo to hi match."""
    if op not in COMPARE:
        raise ValueError(f"unknown operator {op}")
    lo, hi, v = F.col("lo"), F.col("hi"), F.lit(value)
    compare = COMPARE[op]
    if op == "==":
        return (lo == v) & (hi == v), (lo <= v) & (hi >= v)
    return compare(lo, v) & compare(hi, v), compare(lo, v) | compare(hi, v)


def _term(index: ValueIndex, name: str, op: str, value: object) -> DataFrame:
    every, some = _bounds(op, value)
    if name not in index.values:
        return index.rows.select("__run").distinct().withColumn("__sure", _bits("00")).withColumn("__may", _bits("FF"))
    found = index.values[name].where(some)
    return found.groupBy("__run").agg(F.bitmap_or_agg(F.when(every, F.col("bits")).otherwise(_bits("00"))).alias("__sure"), F.bitmap_or_agg("bits").alias("__may"))


def _join(parts: list[DataFrame], every: bool) -> DataFrame:
    if len(parts) == 1:
        return parts[0]
    bits = F.bitmap_and_agg if every else F.bitmap_or_agg
    out = reduce(DataFrame.unionByName, parts).groupBy("__run").agg(bits("__sure").alias("__sure"), bits("__may").alias("__may"), F.count("*").alias("__n"))
    return (out.where(F.col("__n") == len(parts)) if every else out).drop("__n")


def matching_bits(index: ValueIndex, tree: Mapping) -> DataFrame:
    """__run, __sure, __may: the bits of rows that match, and of those that may; runs without any are not there."""
    if "AND" in tree:
        parts, every = [matching_bits(index, t) for t in tree["AND"]], True
    elif "OR" in tree:
        parts, every = [matching_bits(index, t) for t in tree["OR"]], False
        if not parts:
            raise ValueError("an OR needs at least one predicate")
    else:
        parts, every = [_term(index, name, op, value) for name, (op, value) in tree.items()], True
    if not parts:
        return index.rows.where(F.lit(False)).select("__run", _bits("00").alias("__sure"), _bits("00").alias("__may"))
    return _join(parts, every).where(F.bitmap_count("__may") > 0)


def _is_set(bits: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("__bit") % 8)) != 0


def _is_known(index: ValueIndex, name: str, op: str, value: object) -> bool:
    """Whether any row matches a term. Bounds are values that are there, so but for an equal value within a range they tell."""
    _, some = _bounds(op, value)
    if name not in index.values:
        return not index.rows.where(compile_filter({name: (op, value)})).isEmpty()
    values = index.values[name]
    if op != "==" or not values.where((F.col("lo") == F.lit(value)) | (F.col("hi") == F.lit(value))).isEmpty():
        return not values.where(some).isEmpty()
    return not values.where(some).isEmpty() and not index.rows.where(F.col(name) == F.lit(value)).isEmpty()


def known_terms(index: ValueIndex, tree: Mapping) -> Mapping:
    """The tree without the terms of its leaves that no row matches."""
    for node in ("AND", "OR"):
        if node in tree:
            return {node: [known_terms(index, t) for t in tree[node]]}
    return {name: term for name, term in tree.items() if _is_known(index, name, *term)}


def select(index: ValueIndex, tree: Mapping, empty_predicate: str = "sql") -> DataFrame:
    """Rows that match, as ``filters.apply_filter`` has them. The stored rows are not shuffled."""
    if empty_predicate == "ignore":
        tree = known_terms(index, tree)
    elif empty_predicate != "sql":
        raise ValueError("empty_predicate is sql or ignore")
    bits = cut(matching_bits(index, tree))
    few = bits.select("__run").limit(FEW_RUNS + 1).collect()
    rows = index.rows.where(F.col("__run").isin([r["__run"] for r in few])) if len(few) <= FEW_RUNS else index.rows
    met = rows.join(bits, "__run")
    hit = met.where(_is_set("__may")).where(_is_set("__sure") | compile_filter(tree))
    return hit.drop("__run", "__bit", "__sure", "__may")


def count(index: ValueIndex, tree: Mapping) -> int:
    """How many rows match: from the bitmaps alone, unless some ranges are cut by a term."""
    bits = matching_bits(index, tree)
    sure, may = bits.agg(F.coalesce(F.sum(F.bitmap_count("__sure")), F.lit(0)), F.coalesce(F.sum(F.bitmap_count("__may")), F.lit(0))).first()
    return sure if sure == may else select(index, tree).count()
