"""A word tokenizer with abbreviations learnt from the corpus.

Ordered rewrite rules set punctuation and the endings of English contractions apart;
commas and colons between digits stay. What is left is split at white space. A token
that ends in one period loses it to a token of its own, unless it is an abbreviation.

Abbreviations are learnt from counts over all rows, after Kiss and Strunk (2006): for a word
(letters and inner periods, lower-cased) that stands n times, k of them before a period,
the log-likelihood ratio of "a period follows nearly always" against "as often as after
any token" is scaled by its length, its inner periods and the times it stands without.
All steps are DataFrame functions over the distinct tokens. In place, only abbreviations
are gathered by row.

Departures from tokenizers with sentence models: an abbreviation keeps its period at a
sentence's end too, the case of the next word counts for nothing, and single quotes stay
with their word unless they begin an ending. Null texts have null tokens, empty ones none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.checkpoint import cut
from tidepool.functions.text import SPACES
from tidepool.operators import lemmas

#: The share of periods after an abbreviation, and the least score of one (Kiss and Strunk).
SURE, LEAST_SCORE = 0.99, 0.3
#: Patterns and what takes their place, in order. \x01 and \x02 hold commas and colons between digits.
RULES = (
    (r"[\x01\x02]", " "),
    (r"([0-9]),([0-9])", "$1\x01$2"),
    (r"([0-9]),([0-9])", "$1\x01$2"),
    (r"([0-9]):([0-9])", "$1\x02$2"),
    (r"([0-9]):([0-9])", "$1\x02$2"),
    (r"([!?;,:()\[\]{}<>\"“”«»…@#$%&]|--+|\.\.+)", " $1 "),
    (r"\x01", ","),
    (r"\x02", ":"),
    (r"(?i)(\p{L})(n't|'s|'re|'ve|'ll|'d|'m)([ \t\n\r\f\x0B]|$)", "$1 $2 $3"),
    (r"(?i)(\p{L})(n't|'s|'re|'ve|'ll|'d|'m)([ \t\n\r\f\x0B]|$)", "$1 $2 $3"),
)
_MARK = "\x01"


def raw_tokens(text: Column) -> Column:
    """Tokens before final periods are set apart."""
    for pattern, by in RULES:
        text = F.regexp_replace(text, pattern, by)
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def raw_vocabulary(rows: DataFrame, text: str = "text") -> DataFrame:
    """token, n: the distinct raw tokens of all texts; computed once.

    No rule reaches beyond white space, so the rules rewrite distinct stretches without any, not texts.
    Only in a text's last stretch an ending may stand before a line end that is no white space here.
    """
    split = rows.select(F.split(text, SPACES).alias("stretches"))
    each = split.select((F.size("stretches") - 1).alias("last"), F.posexplode("stretches").alias("pos", "stretch"))
    final = (F.col("pos") == F.col("last")) & F.col("stretch").rlike(r"[\u0085\u2028\u2029]\z")
    counted = cut(each.where("stretch <> ''").groupBy("stretch", final.alias("final")).agg(F.count("*").alias("n")))
    follow = F.when(F.col("final"), F.col("stretch")).otherwise(F.concat("stretch", F.lit(" ")))
    return cut(counted.select(F.explode(raw_tokens(follow)).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n")))


def _ends(token: Column) -> Column:
    """Whether it ends in one period that follows something else."""
    return token.rlike(r"[^.]\.$")


def scored(words: DataFrame) -> DataFrame:
    """word, n_with, n_without, score of all words before a period; words has token and n of raw tokens."""
    n_with = F.sum(F.when(_ends(F.col("token")), F.col("n")).otherwise(0))
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(n_with, F.lit(0))).first()
    share = totals[1] / max(1, totals[0])
    # a row of each token under its word
    word = F.lower(F.when(_ends(F.col("token")), F.regexp_replace("token", r"\.$", "")).otherwise(F.col("token")))
    by = words.withColumn("word", word).where(F.col("word").rlike(r"^\p{L}(\p{L}|\.\p{L})*$")).groupBy("word")
    counts = by.agg(n_with.alias("k"), F.sum("n").alias("n")).where("k > 0")
    log = lambda p: F.lit(p).cast("double") if p is None else F.log(F.lit(float(p)))
    missed = F.col("n") - F.col("k")
    chance = F.col("k") * log(share) + F.when(missed > 0, missed * log(1 - share)).otherwise(0.0)
    sure = F.col("k") * log(SURE) + missed * log(1 - SURE)
    letters = F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    inner = F.length("word") - letters
    score = 2 * (sure - chance) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), -missed.cast("double"))
    return counts.select("word", F.col("k").alias("n_with"), missed.alias("n_without"), F.round(score, 6).alias("score"))


def abbreviations(words: DataFrame) -> DataFrame:
    """word, n_with, n_without, score of those learnt."""
    return scored(words).where(F.col("score") >= LEAST_SCORE)


def _known(words: DataFrame) -> DataFrame:
    """The tokens, periods included, that are abbreviations."""
    held = words.where(_ends(F.col("token"))).select("token", F.lower(F.regexp_replace("token", r"\.$", "")).alias("word"))
    return held.join(abbreviations(words).select("word"), "word").select("token")


def _parts(token: Column) -> Column:
    return F.when(_ends(token), F.array(F.regexp_replace(token, r"\.$", ""), F.lit("."))).otherwise(F.array(token))


def token_counts(words: DataFrame) -> DataFrame:
    """token, n after final periods are set apart, from the raw tokens' counts alone."""
    kept = words.join(_known(words).withColumn("known", F.lit(True)), "token", "left")
    parts = F.when(F.col("known"), F.array("token")).otherwise(_parts(F.col("token")))
    return kept.select(F.explode(parts).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))


def tokenize(rows: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key and tokens of each text in their order; the key names a row."""
    raw = rows.select(*key, raw_tokens(F.col(text)).alias("tokens"))
    words = lemmas.vocabulary(raw)
    marked = _known(words).select("token", F.concat("token", F.lit(_MARK)).alias("lemma"))
    out = lemmas.put(raw, key, words, marked, _ends(F.col("token")))
    own = lambda t: F.when(t.endswith(_MARK), F.array(F.regexp_replace(t, _MARK, ""))).otherwise(_parts(t))
    return out.select(*key, F.flatten(F.transform("tokens", own)).alias("tokens"))
