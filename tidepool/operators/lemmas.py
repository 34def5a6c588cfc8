"""Lemmas of a corpus: suffixes are detached from its distinct words, and the result is joined back.

A form is accepted if it is a word of the corpus itself, which takes the place of a
dictionary; of a word's accepted forms, itself among them, the shortest is its lemma, and
of equally short ones the first by bytes. Irregular words have their lemma from a table.
Only words of a to z are changed, and none to fewer than ``LEAST`` letters; words in "ss"
stay. All steps are DataFrame functions over the vocabulary.

Tokens that no rule fits meet nothing. Of the others, words that make up over
``HOT_SHARE`` of all tokens are broadcast with their lemmas, 1 / HOT_SHARE at most; the
rest is met by a shuffle in which no word has more than its share of the rows.

Defined results: null and empty arrays stay as they are, null tokens are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.checkpoint import cut

LEAST = 3
HOT_SHARE = 1e-5
#: Endings of English nouns and what takes their place.
SUFFIXES = {"s": "", "ses": "s", "ves": "f", "xes": "x", "zes": "z", "ches": "ch", "shes": "sh", "men": "man", "ies": "y"}
#: Irregular English nouns.
IRREGULAR = {
    "children": "child", "feet": "foot", "geese": "goose", "mice": "mouse", "teeth": "tooth", "oxen": "ox", "lice": "louse",
    "indices": "index", "vertices": "vertex", "matrices": "matrix", "appendices": "appendix", "analyses": "analysis",
    "crises": "crisis", "theses": "thesis", "hypotheses": "hypothesis", "criteria": "criterion", "phenomena": "phenomenon",
    "lives": "life", "wives": "wife", "knives": "knife",
}


def forms(word: Column) -> Column:
    """What is left of a word by each rule that fits it."""
    cut_off = [
        F.when(word.endswith(old) & (F.length(word) - len(old) + len(new) >= LEAST), F.concat(F.substring(word, F.lit(1), F.length(word) - len(old)), F.lit(new)))
        for old, new in SUFFIXES.items()
    ]
    return F.when(word.rlike("^[a-z]+$") & ~word.endswith("ss"), F.array_compact(F.array(*cut_off))).otherwise(F.array().cast("array<string>"))


def changed(words: DataFrame) -> DataFrame:
    """token, lemma, n of the words that have another lemma; words has the distinct tokens and their counts n."""
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    irregular = words.where(F.col("token").isin(list(IRREGULAR))).select("token", known[F.col("token")].alias("lemma"), "n")
    tried = words.where(~F.col("token").isin(list(IRREGULAR))).select("token", "n", F.explode(forms(F.col("token"))).alias("lemma"))
    accepted = tried.join(words.select(F.col("token").alias("lemma")), "lemma", "left_semi")
    best = accepted.groupBy("token").agg(F.min(F.struct(F.length("lemma").alias("size"), "lemma")).alias("best"), F.first("n").alias("n"))
    # a rule can leave a word as long as it was: then the first of the two by bytes counts
    shorter = (F.col("best.size") < F.length("token")) | ((F.col("best.size") == F.length("token")) & (F.col("best.lemma") < F.col("token")))
    return best.where(shorter).select("token", "best.lemma", "n").unionByName(irregular)


def vocabulary(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """token, n: the distinct tokens of all rows; computed once."""
    return cut(rows.select(F.explode(tokens).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n")))


def lemma_counts(words: DataFrame) -> DataFrame:
    """token, n by lemma, from the vocabulary alone."""
    lemmas = changed(words).select("token", "lemma")
    return words.join(lemmas, "token", "left").groupBy(F.coalesce("lemma", "token").alias("token")).agg(F.sum("n").alias("n"))


def lemmatize(rows: DataFrame, key: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """key and tokens with each token's lemma in its place; the key names a row."""
    words = vocabulary(rows, tokens)
    ends = reduce(or_, [F.col("token").endswith(old) for old in SUFFIXES])
    fits = F.col("token").isin(list(IRREGULAR)) | (ends & F.col("token").rlike("^[a-z]+$") & ~F.col("token").endswith("ss"))
    return put(rows, key, words, changed(words).select("token", "lemma"), fits, tokens)


def put(rows: DataFrame, key: Sequence[str], words: DataFrame, other: DataFrame, fits: Column, tokens: str = "tokens") -> DataFrame:
    """key and tokens, with the lemma of each token that ``other`` (token, lemma) holds in its place.

    words are the distinct tokens of rows and their counts n; fits, a condition on a token, holds for all tokens of
    ``other`` at least. Only changed tokens are gathered by row, with their places; a row's tokens between them
    are kept as they stand.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lemmas = cut(words.where(fits).join(other, "token", "left").select("token", "lemma", (F.col("n") >= HOT_SHARE * total).alias("hot")))
    whole = rows.select(*key, F.array_compact(tokens).alias("own"))
    each = whole.select(*key, F.posexplode("own").alias("pos", "token")).where(fits)
    met = each.join(F.broadcast(lemmas.where("hot").select("token", "lemma", "hot")), "token", "left").where("hot is null or lemma is not null")
    met = cut(met)  # read twice, and cheaper to keep than the rows are to read again
    rare = met.where("hot is null").drop("lemma", "hot").join(lemmas.where("not hot and lemma is not null").select("token", "lemma"), "token")
    met = met.where("hot").drop("hot").unionByName(rare)
    placed = met.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "lemma"))).alias("placed"))
    back = whole.alias("a").join(placed.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key], "left")
    after = lambda i: F.coalesce(F.get("placed", i)["pos"], F.lit(-1)) + 2  # noqa: E731  slices count from 1
    runs = F.transform("placed", lambda x, i: F.concat(F.slice("own", after(i - 1), x["pos"] + 1 - after(i - 1)), F.array(x["lemma"])))
    start = after(F.size("placed") - 1)
    joined = F.concat(F.flatten(runs), F.slice("own", start, F.greatest(F.lit(0), F.size("own") + 1 - start)))
    return back.select(*[F.col(f"a.{k}") for k in key], F.when(F.col("placed").isNull(), F.col("own")).otherwise(joined).alias(tokens))
