"""Line dedup across documents, by DataFrame functions alone.

Each line gets a 128-bit hash of its key. The hashes are range-partitioned and
sorted within their range by document and position, so that the first document
of a key streams by before its later ones; lines of later documents are dropped.
What comes back is one compressed keep bitmap per document, never text: a word
of bits for each 64 lines of which any is dropped, a set bit for a line that
stays; words without drops are left out.

Skew: a key is hot if it has over ``hot_lines`` lines and over a millionth of all
lines, so there are at most a million hot keys at any size, and no range stream
holds more of one key. A map-side combined count over hash buckets finds the
buckets that can hold a hot key, and an exact count in these finds the keys. The
smallest document of each hot key is a map-side combined minimum; the hot keys
are broadcast, and their lines are judged where they are, without a shuffle.

Defined results: a null or empty text is one empty line. Lines whose key is
shorter than ``min_chars`` code points always stay. Rows that repeat a doc_id
share its lines' fate: a line is dropped if its key occurs in a smaller doc_id.
A row without doc_id loses nothing and counts as no holder. Equal rows are
decided alike and all stay. Extra columns pass through ``dedup_lines`` whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut, lower_ascii, row_key, text_or_empty

#: Hot keys are at most so many, and buckets about four times as many.
MOST_HOT = 1_000_000
#: Hash buckets at least, in which lines are counted before they are dealt out.
BUCKETS = 1 << 16
WORD = 64


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """ASCII white space off both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _keyed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.select("doc_id", row_key().alias("row_key"), F.posexplode(lines_of(text_or_empty())).alias("pos", "line"))
    keys = lines.select("doc_id", "row_key", "pos", line_key(F.col("line")).alias("key"))
    return keys.where((F.char_length("key") >= min_chars) & F.col("doc_id").isNotNull()).select("doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, hot_lines: int = 1_000) -> DataFrame:
    """doc_id, row_key, n_lines, n_dropped, keep: array<struct<word, bits>>, bit i of word w is set if line 64 w + i stays.

    Words of 64 lines that all stay are left out. ``hot_lines`` is the least number of lines of a hot key.
    """
    docs = docs.select("doc_id", "text")
    lines = cut(_keyed_lines(docs, min_chars))
    least = max(hot_lines, lines.count() // MOST_HOT)
    bucket = F.pmod("h1", F.lit(max(BUCKETS, 4 * MOST_HOT if least > hot_lines else 0)))
    full = lines.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > least).select("bucket")
    maybe = lines.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")
    found = maybe.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") > least)
    hot = F.broadcast(cut(found.select("h1", "h2", "first_doc")))  # at most MOST_HOT rows, as each has over a millionth of the lines

    cold = lines.join(hot, ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    stream = Window.partitionBy("h1", "h2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = F.col("doc_id") > F.col("first_doc")
    dropped = cold.withColumn("first_doc", F.first("doc_id").over(stream)).where(later).select("doc_id", "row_key", "pos")
    dropped = dropped.unionByName(lines.join(hot, ["h1", "h2"]).where(later).select("doc_id", "row_key", "pos"))

    # a word's dropped bits first, turned over once the document's last, shorter word is known
    gone = dropped.groupBy("doc_id", "row_key", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {WORD})")).alias("bits"))
    none = F.lit(None)
    sizes = docs.select("doc_id", row_key().alias("row_key"), F.size(lines_of(text_or_empty())).alias("n_lines"), none.cast("struct<word:int,bits:bigint>").alias("gone"))
    words = sizes.unionByName(gone.select("doc_id", "row_key", none.cast("int").alias("n_lines"), F.struct("word", "bits").alias("gone")))
    per = words.groupBy("doc_id", "row_key").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_list("gone")).alias("gone"))
    # a word of n lines has n bits to keep; 64 of them are all bits of a long
    left = f"n_lines - x.word * {WORD}"
    keep = F.expr(f"transform(gone, x -> struct(x.word AS word, (CASE WHEN {left} >= {WORD} THEN -1L ELSE shiftrightunsigned(-1L, {WORD} - ({left})) END) & ~x.bits AS bits))")
    n_dropped = F.aggregate("gone", F.lit(0), lambda n, x: n + F.bit_count(x["bits"]))
    return per.select("doc_id", "row_key", "n_lines", n_dropped.alias("n_dropped"), keep.alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (a struct of the document's columns), kept_text, n_lines, n_dropped."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), row_key().alias("key"))
    b = bitmaps.select("doc_id", "row_key", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.when(F.col("n_dropped") > 0, F.map_from_entries("keep")).alias("keep"))
    joined = own.join(b.hint("shuffle_hash"), F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("row_key")), "left")
    kept = F.expr(f"array_join(filter(split(coalesce(row.text, ''), '\n', -1), (line, i) -> (shiftright(coalesce(keep[cast(i div {WORD} as int)], -1L), i % {WORD}) & 1L) = 1L), '\n')")
    return joined.select("row", F.when(F.col("n_dropped") > 0, kept).otherwise(text_or_empty("row.text")).alias("kept_text"), "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """The columns of docs, with the text that is left; a null text without drops stays null."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars))
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text")).alias("text")
    return out.select(*[text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
