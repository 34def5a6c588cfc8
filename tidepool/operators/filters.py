"""Metadata predicates as nested dicts, compiled to one column expression.

{"AND": [..]} comes before {"OR": [..]}, which comes before a leaf; keys beside
them don't count. A leaf is {key: (operator, value), ..}, all of which must hold.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {"==": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def leaf_terms(leaf: Mapping) -> list[Column]:
    for op, _ in leaf.values():
        if op not in COMPARE:
            raise ValueError(f"unknown operator {op}")
    return [F.coalesce(COMPARE[op](F.col(key), F.lit(value)), F.lit(False)) for key, (op, value) in leaf.items()]


def compile_filter(tree: Mapping) -> Column:
    """A row without the key does not match; an empty AND or leaf matches nothing; an empty OR is an error."""
    if "AND" in tree:
        return _all([compile_filter(t) for t in tree["AND"]])
    if "OR" in tree:
        return _any([compile_filter(t) for t in tree["OR"]])
    return _all(leaf_terms(tree))


def _all(terms: list[Column]) -> Column:
    out = terms[0] if terms else F.lit(False)
    for t in terms[1:]:
        out = out & t
    return out


def _any(terms: list[Column]) -> Column:
    if not terms:
        raise ValueError("an OR needs at least one predicate")
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return out


def apply_filter(rows: DataFrame, tree: Mapping, empty_predicate: str = "sql", distinct: bool = False) -> DataFrame:
    """Rows that match.

    With empty_predicate="ignore", a term of a leaf that no row of the table
    matches is left out of its leaf, unless none of the leaf's terms matches any.
    Which terms those are is one aggregate over the table, so rows aren't gathered.
    """
    if empty_predicate == "sql":
        out = rows.where(compile_filter(tree))
    elif empty_predicate == "ignore":
        terms = _leaves(tree)
        known = [k for leaf in terms for k in leaf]
        flat = [t for leaf in terms for t in leaf_terms(leaf)]
        hits = rows.agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(f"t{i}") for i, t in enumerate(flat)]).first() if known else []
        out = rows.where(_compile_known(tree, iter(list(hits))))
    else:
        raise ValueError("empty_predicate is sql or ignore")
    return out.dropDuplicates() if distinct else out


def _leaves(tree: Mapping) -> list[Mapping]:
    if "AND" in tree:
        return [x for t in tree["AND"] for x in _leaves(t)]
    if "OR" in tree:
        return [x for t in tree["OR"] for x in _leaves(t)]
    return [tree]


def _compile_known(tree: Mapping, hits) -> Column:
    if "AND" in tree:
        return _all([_compile_known(t, hits) for t in tree["AND"]])
    if "OR" in tree:
        return _any([_compile_known(t, hits) for t in tree["OR"]])
    return _all([t for t in leaf_terms(tree) if next(hits)])


def in_windows(chunks: DataFrame, centres: DataFrame, bin_size: int = 8) -> DataFrame:
    """Chunks of a source that stand in one of its centre windows: centres has source_md5 and centre.

    Windows are cut into bins of ``bin_size`` and meet the centres of their source's
    bins by an equal join, so a chunk meets no centre far from it. A bin knows the
    last centre before it: a chunk counts in the first bin where a centre hits it,
    so it is there once. Chunks without bounds stand in no window.
    """
    bin_of = lambda x: F.floor(F.col(x) / bin_size)
    c = centres.select(F.col("source_md5").alias("__source"), "centre").dropDuplicates()
    bins = c.groupBy("__source", bin_of("centre").alias("__bin")).agg(F.collect_list("centre").alias("__centres"), F.max("centre").alias("__last"))
    bins = bins.withColumn("__before", F.lag("__last").over(Window.partitionBy("__source").orderBy("__bin"))).withColumnRenamed("__bin", "__at")
    cut = chunks.where("win_lo <= win_hi").withColumn("__bin", F.explode(F.sequence(bin_of("win_lo"), bin_of("win_hi"))))
    met = cut.join(bins, (F.col("source_md5") == F.col("__source")) & (F.col("__bin") == F.col("__at")))
    hit = F.exists("__centres", lambda x: x.between(F.col("win_lo"), F.col("win_hi"))) & (F.col("__before").isNull() | (F.col("__before") < F.col("win_lo")))
    return met.where(hit).select(*[chunks[x] for x in chunks.columns])
