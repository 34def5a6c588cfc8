"""Chunks, count windows and their roll-up, per source."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tidepool.functions.text import Lemmatizer, clean_tokens, title, words


def split_by_words(pages: DataFrame, size: int = 100, overlap: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """source, page, small_chunk_idx, n_chunks, raw_text and columns to ``keep``: runs of ``size`` words, none across pages.

    ``pages`` has source, text and, if sources have several rows, page. A page is
    sliced in place, so nothing but page counts is shuffled, and not even those without pages.
    """
    step = size - overlap
    w = words(F.col("text"))
    n = F.when(F.size(w) == 0, 0).when(F.size(w) <= size, 1).otherwise(F.ceil((F.size(w) - overlap) / step)).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array_join(F.slice(F.col("w"), (i - 1) * step + 1, size), " "))
    cut = pages.withColumn("w", w).withColumn("n", n)
    return _numbered(cut, F.when(F.col("n") > 0, chunks).otherwise(F.array().cast("array<string>")), keep)


def _numbered(pages: DataFrame, chunks: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Explodes each page's chunks and numbers them through the source, from 0."""
    if "page" in pages.columns:
        by = Window.partitionBy("source")
        pages = pages.withColumn("before", F.coalesce(F.sum("n").over(by.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n_chunks", F.sum("n").over(by))
    else:
        pages = pages.withColumn("before", F.lit(0)).withColumn("n_chunks", F.col("n")).withColumn("page", F.lit(None).cast("int"))
    rows = pages.select(*keep, "source", "page", "before", "n_chunks", F.posexplode(chunks).alias("i", "raw_text"))
    return rows.select(*keep, "source", "page", (F.col("before") + F.col("i")).cast("int").alias("small_chunk_idx"), F.col("n_chunks").cast("int").alias("n_chunks"), "raw_text")


def recursive_split(text: str, size: int, overlap: int, length: Callable[[str], int], separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size``, cut at the coarsest separator that is there; small neighbours are joined again."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        joined = sep.join(held).strip()
        if joined:
            out.append(joined)

    for part in text.split(sep) if sep else list(text):
        if part and length(part) > size and finer:
            close()
            held.clear()
            out += recursive_split(part, size, overlap, length, finer)
        elif part:
            if held and length(sep.join([*held, part])) > size:
                close()
                while held and (length(sep.join(held)) > overlap or length(sep.join([*held, part])) > size):
                    held.pop(0)
            held.append(part)
    close()
    return out


def split_recursively(pages: DataFrame, size: int, overlap: int = 0, length: Callable[[str], int] | None = None) -> DataFrame:
    """As ``split_by_words`` with separators and a token counter of the caller's."""
    count = length or (lambda s: len(s.split()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(chunks=[recursive_split(t or "", size, overlap, count) for t in b["text"]])

    has_page = "page" in pages.columns
    cols = ["source", *(["page"] if has_page else []), "text"]
    cut = pages.select(*cols).mapInPandas(run, "source string, " + ("page int, " if has_page else "") + "chunks array<string>")
    return _numbered(cut.withColumn("n", F.size("chunks")), F.col("chunks"))


def add_windows(chunks: DataFrame, steps: int = 3, size: int = 18) -> DataFrame:
    """win_lo, win_hi: the least and greatest sliding window that a chunk stands in.

    Window w opens at chunk w * steps while over ``size`` chunks follow, and the
    oldest ``steps`` chunks leave once over ``size`` are held; in closed form.
    """
    if not 1 <= steps <= size:
        raise ValueError("steps must be from 1 to size")
    i, n = F.col("small_chunk_idx"), F.col("n_chunks")
    opened = lambda j: F.greatest(F.lit(0), F.floor(F.least(j, n - size - 1) / steps)).cast("int")
    oldest = F.when(i < size, F.lit(0)).otherwise(steps * (F.floor((i - size) / steps) + 1))
    return chunks.withColumn("win_lo", opened(oldest)).withColumn("win_hi", opened(i))


def merge_chunks(chunks: DataFrame, scale: int = 3, parity: bool = False, by: Sequence[str] = ("source",)) -> DataFrame:
    """Every ``scale`` chunks made one, texts joined without a separator, numbers rolled up to bounds.

    ``by`` names the source; a store that is bucketed by one of its columns is merged without a shuffle.

    win_lo and win_hi are the hull of the merged windows. With ``parity`` they are
    null where the merged chunks' own bounds differ. win_bounds has the whole roll-up.
    """
    g = chunks.groupBy(*by, F.floor(F.col("small_chunk_idx") / scale).cast("int").alias("medium_chunk_idx")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("small_chunk_idx", "raw_text"))), lambda x: x["raw_text"]), "").alias("raw_text"),
        F.min("page").alias("page_lo"),
        F.max("page").alias("page_hi"),
        F.min("small_chunk_idx").alias("small_lo"),
        F.max("small_chunk_idx").alias("small_hi"),
        F.struct(F.min("win_lo").alias("lo_lo"), F.max("win_lo").alias("lo_hi"), F.min("win_hi").alias("hi_lo"), F.max("win_hi").alias("hi_hi")).alias("win_bounds"),
    )
    b = F.col("win_bounds")
    if parity:
        lo, hi = F.when(b["lo_lo"] == b["lo_hi"], b["lo_lo"]), F.when(b["hi_lo"] == b["hi_hi"], b["hi_lo"])
    else:
        lo, hi = b["lo_lo"], b["hi_hi"]
    return g.withColumn("win_lo", lo).withColumn("win_hi", hi)


def roll_up(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """keys, and for any metadata column c what its rows hold, in their ``order``; a null is no value.

    c: the value, if all rows that have one agree. Else a number's c_lower_bound and c_upper_bound, and for
    other types c_values, the distinct values in order of first appearance.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    out: list[Column] = []
    for c in columns:
        if isinstance(kinds[c], (NumericType, BooleanType)):
            many = F.min(c) < F.max(c)
            out += [F.when(~many, F.min(c)).alias(c), F.when(many, F.min(c)).alias(f"{c}_lower_bound"), F.when(many, F.max(c)).alias(f"{c}_upper_bound")]
        else:
            first = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v")))))
            held = F.array_distinct(F.transform(first, lambda x: x["v"]))
            many = F.size(held) > 1
            out += [F.when(F.size(held) == 1, F.element_at(held, 1)).alias(c), F.when(many, held).alias(f"{c}_values")]
    return rows.groupBy(*keys).agg(*out)


def enrich(chunks: DataFrame, lemmatize: Lemmatizer | None = None) -> DataFrame:
    """Adds digests, title, the text to embed and the tokens and text for lexical search."""
    out = chunks.withColumn("file_name", F.element_at(F.split("source", "/"), -1)).withColumn("title", title(F.col("source")))
    out = out.withColumn("source_md5", F.md5("source")).withColumn("raw_md5", F.md5("raw_text"))
    out = out.withColumn("embed_text", F.concat("title", F.lit("\n"), "raw_text"))
    return out.withColumn("tokens", clean_tokens(F.col("embed_text"), lemmatize)).withColumn("bm25_text", F.array_join("tokens", " "))
