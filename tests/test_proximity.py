"""Closeness of a question's terms, against loops; three stages with rows chosen by it."""

import random

from tidepool.operators import proximity


def model(tokens, terms):
    """(terms held, narrowest width) by all spans."""
    held = set(terms) & set(tokens or [])
    if not held:
        return 0, None
    ends = [(a, b) for a in range(len(tokens)) for b in range(a, len(tokens)) if held <= set(tokens[a : b + 1])]
    return len(held), min(b - a + 1 for a, b in ends)


def test_closeness(spark):
    rng = random.Random(3)
    rows = [(q, rank, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 25))]) for q in range(12) for rank in range(1, 7)]
    rows += [(20, 1, None), (20, 2, []), (20, 3, ["a", None, "b", "a"]), (20, 4, ["a", None, "b", "a"]), (20, 5, ["b"]), (21, 1, ["z"])]
    asked = [(q, [rng.choice("abcdefghxyz") for _ in range(rng.randint(0, 6))]) for q in range(12)] + [(20, ["a", "b", "a"]), (21, ["a"]), (22, ["a"])]
    candidates = spark.createDataFrame(rows, "query_id int, rank int, tokens array<string>")
    queries = spark.createDataFrame(asked, "query_id int, tokens array<string>")
    want = {(q, rank): model(tokens, dict(asked)[q]) for q, rank, tokens in rows}
    got = {(r["query_id"], r["rank"]): (r["terms"], r["width"]) for r in proximity.closeness(candidates, queries).collect()}
    assert got == want and want[20, 3] == (2, 2)
    chosen = {r["query_id"]: r["ids"] for r in proximity.choose(candidates, queries).collect()}
    for q in dict(asked):
        order = sorted((-t, w, rank) for (x, rank), (t, w) in want.items() if x == q and t)
        assert chosen.get(q, []) == [rank - 1 for _, _, rank in order[:2]]
    assert proximity.choose(candidates.limit(0), queries).count() == 0


def test_a_very_long_candidate(spark):
    tokens = ["a"] * 100_000 + ["x"] * 5 + ["b"] + ["c"] * 100_000 + ["a", "b"]
    rows = spark.createDataFrame([(1, 1, tokens)], "query_id int, rank int, tokens array<string>")
    asked = spark.createDataFrame([(1, ["a", "b", "nowhere"])], "query_id int, tokens array<string>")
    assert [tuple(r) for r in proximity.closeness(rows, asked).collect()] == [(1, 1, 2, 2)]


def test_rows_chosen_for_files(spark):
    from tidepool.plans import retrieval

    rows = [(1, 1, "f1", ["a"]), (1, 2, "f2", ["a", "x", "b"]), (1, 3, "f1", ["b", "a"]), (1, 4, "f3", ["a", "b", "c"]), (2, 1, "f1", ["x"]), (3, 1, "f1", ["c"])]
    stage1 = spark.createDataFrame([(q, k, s, s, " ".join(t), t) for q, k, s, t in rows], "query_id int, rank int, source_md5 string, source string, raw_text string, tokens array<string>")
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"])], "query_id int, tokens array<string>")
    got = retrieval.select_rows(stage1, queries, chooser=proximity.choose).collect()
    # question 1: ranks 3 and 4 hold both terms side by side; question 2 has no term anywhere, so it picks nothing
    assert sorted((r["query_id"], r["source_pos"], r["source_md5"], r["rank"]) for r in got) == [(1, 1, "f1", 3), (1, 2, "f3", 4), (3, 1, "f1", 1)]


def test_three_stages_with_it(spark, sf):
    """Only files of the rows that the closeness names are searched."""
    from pyspark.sql import functions as F

    from tidepool.functions.text import clean_tokens
    from tidepool.plans import retrieval
    from tidepool.plans.ingest import embedded_chunks
    from tidepool.plans.queries import _pages
    from tidepool.providers import get_embedding

    from tests.test_queries import fused_model

    small, medium = embedded_chunks(_pages(spark, sf))
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    queries = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("num_query"), clean_tokens(F.col("text")).alias("tokens"), get_embedding("hashing")(F.col("text")).alias("embedding"))
    got = {}
    for r in retrieval.retrieve(small, medium, queries, chooser=proximity.choose).collect():
        got.setdefault(r["query_id"], {})[r["source_pos"]] = r["source_md5"]
    rows = {f"{r['source_md5']}#{r['small_chunk_idx']}": r for r in small.collect()}
    want = {}
    for q in queries.collect():
        first = fused_model(rows, q["tokens"], q["embedding"], 3)
        held = [(*model(rows[d]["tokens"], q["tokens"]), rank, rows[d]["source_md5"]) for rank, d in enumerate(first)]
        order = sorted((-t, w, rank, s) for t, w, rank, s in held if t)[:2]
        files = list(dict.fromkeys(s for *_, s in order))
        if files:
            want[q["query_id"]] = dict(enumerate(files, 1))
    assert got == want and want
