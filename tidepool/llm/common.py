"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.checkpoint import cut

__all__ = ["cut", "lower_ascii", "row_key", "table", "text_or_empty", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def row_key(col: str = "text") -> Column:
    """Tells rows of one doc_id apart by their text; equal rows share the key and so every decision."""
    return F.xxhash64(text_or_empty(col))


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z alone; letters beyond ASCII stay."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unused(taken: Iterable[str], name: str) -> str:
    """A column name like ``name`` that none of the taken ones clashes with, in any case of letters."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = "_" + name
    return name
