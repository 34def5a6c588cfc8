"""Text, prompt and interval functions on hand-made inputs."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidepool.functions import prompts
from tidepool.functions import text as tx
from tidepool.functions.intervals import centres, interval_centres

VECTORS = [
    ([(1, 6)], [4]),
    ([(1, 6), (2, 7)], [4]),
    ([(1, 6), (1, 6)], [4]),
    ([(0, 2), (5, 7)], [1, 6]),
    ([(1, 6), (4, 9), (8, 13)], [6, 7, 8]),
    ([(1, 6), (8, 13), (4, 9)], [6, 11]),
    ([(5, 10), (1, 5), (10, 14)], [5]),
    ([(5, 10), (8, 12), (0, 9)], [10, 9, 8]),
]


@pytest.mark.parametrize(("given_", "want"), VECTORS)
def test_centres(given_, want):
    assert centres(given_) == want


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 8)).map(lambda x: (x[0], x[0] + x[1])), max_size=8))
def test_centres_stay_in_the_hull(intervals):
    out = centres(intervals)
    assert bool(out) == bool(intervals)
    if intervals:
        assert min(a for a, _ in intervals) <= min(out) and max(out) <= max(b for _, b in intervals)


def test_centres_column(spark):
    df = spark.createDataFrame([([(1, 6), (4, 9), (8, 13)],), ([],), (None,)], "x array<struct<lo:int,hi:int>>")
    assert [r[0] for r in df.select(interval_centres(F.col("x"), 2)).collect()] == [[6, 7], [], []]


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_clean(spark):
    assert one(spark, "The [SEP]Cats, and 3 dogs' x2 -- don't É_a", tx.clean_text) == "cats 3 dogs x2 dont éa"
    assert one(spark, "", tx.clean_text) == ""
    assert one(spark, None, tx.clean_text) is None
    assert one(spark, "dogs", lambda c: tx.clean_text(c, lambda w: F.regexp_replace(w, "s$", ""))) == "dog"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("1. a\n2. b\r\n3. c", ["a", "b\r", "c"]),
        ("1. a 2. b\n", ["a 2. b"]),
        ("Standalone questions: \nwhat is\n\n(2) why", ["what is", "why"]),
        ("Query: x\nQuery 2: y\n3) z\n4 w", ["x", "y", " z"]),
        ("", []),
    ],
)
def test_questions(spark, raw, want):
    assert one(spark, raw, tx.standalone_questions) == want


@pytest.mark.parametrize(("raw", "want"), [("pick [0, 2,1] or [3]", [0, 2, 1]), ("[ 4 ,\n5 ]", [4, 5]), ("[]", []), ("no", []), ("[a] [4]", [4])])
def test_ids(spark, raw, want):
    assert one(spark, raw, tx.chosen_ids) == want


def test_names(spark):
    assert one(spark, "/a.b/c.tar.gz", tx.title) == "c.tar"
    assert one(spark, "/a/.rc", tx.title) == ".rc"
    assert one(spark, "/a/c.PDF", tx.extension) == "PDF"
    assert one(spark, "Human: hi", tx.strip_speaker) == "hi"
    assert one(spark, "p|m|f", tx.model_parts) == ["p", "m", "f"]


def test_prompts(spark):
    df = spark.createDataFrame([("{query} \\1", "q?")], "s string, q string")
    assert "{query} \\1\n\nQuestion: q?" in df.select(prompts.select("stub", F.col("s"), F.col("q"))).first()[0]
    assert df.select(prompts.select("some-LLaMA", F.col("s"), F.col("q"))).first()[0].startswith("[INST] ")
    chat = df.select(prompts.answer("stub", F.col("s"), F.lit("h"), F.col("q"), chat=True)).first()[0]
    assert [m["role"] for m in chat] == ["system", "human"]
