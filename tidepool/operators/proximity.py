"""How closely the terms of a question stand together in its candidates.

The postings of the candidates keep places: for each term of the question the places
at which a candidate holds it. A sweep over a candidate's places in their order keeps the
last place of every term; the span from the least of these to the place at hand is the
narrowest that ends there and holds all terms that the candidate has. Candidates are
ordered by how many different terms they have, then by the width of their narrowest
span, then by rank. All steps are DataFrame functions.

Defined results: a candidate without a term of its question has 0 terms and no width;
null and empty tokens hold no term; equal candidates keep the order of their ranks. A
sweep holds the places of one question in one candidate, however long that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def postings(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, token, places. candidates: query_id, rank, tokens; queries: query_id, tokens."""
    asked = queries.select("query_id", F.array_distinct("tokens").alias("terms"))
    each = candidates.select("query_id", "rank", F.posexplode("tokens").alias("pos", "token")).where("token is not null")
    held = each.join(asked, "query_id").where(F.array_contains("terms", F.col("token")))
    return held.groupBy("query_id", "rank", "token").agg(F.array_sort(F.collect_list("pos")).alias("places"))


def narrowest(places: Column) -> Column:
    """Width of the narrowest span that holds a place of each list; an array of arrays of places, none of them empty."""
    hits = F.array_sort(F.flatten(F.transform(places, lambda own, i: F.transform(own, lambda p: F.struct(p.alias("at"), i.alias("term"))))))
    width = lambda s: F.when(F.array_min(s["last"]) >= 0, F.least(s["best"], s["at"] - F.array_min(s["last"]) + 1)).otherwise(s["best"])
    none = F.lit(None).cast("int")  # least() leaves nulls out
    start = F.struct(F.transform(places, lambda own: F.lit(-1)).alias("last"), none.alias("at"), none.alias("best"))
    step = lambda s, x: F.struct(F.transform(s["last"], lambda p, i: F.when(i == x["term"], x["at"]).otherwise(p)).alias("last"), x["at"].alias("at"), width(s).alias("best"))
    return F.aggregate(hits, start, step, width)


def closeness(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, terms, width for every candidate."""
    by = postings(candidates, queries).groupBy("query_id", "rank").agg(F.collect_list("places").alias("places"))
    found = by.select("query_id", "rank", F.size("places").alias("terms"), narrowest(F.col("places")).alias("width"))
    return candidates.select("query_id", "rank").join(found, ["query_id", "rank"], "left").select("query_id", "rank", F.coalesce("terms", F.lit(0)).alias("terms"), "width")


def in_order(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, terms, width, place: candidates that hold a term, the closest first."""
    by = Window.partitionBy("query_id").orderBy(F.desc("terms"), F.asc("width"), F.asc("rank"))
    return closeness(candidates, queries).where("terms > 0").withColumn("place", F.row_number().over(by))


def choose(candidates: DataFrame, queries: DataFrame, at_most: int = 2) -> DataFrame:
    """query_id, ids: the closest candidates of each question, named by rank - 1 in their order; a question without any names none."""
    best = in_order(candidates, queries).where(F.col("place") <= at_most)
    return best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank"))), lambda x: (x["rank"] - 1).cast("int")).alias("ids"))
