"""Byte-pair lengths and chunks against the tokenizer library."""

import numpy as np
import pytest
import regex

from tidepool.operators import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

AWKWARD = [None, "", " ", "   \n\n  x", "it's  'LL we'll\tyou me 　x", "a" * 20_000, "ab" * 3_000 + " " * 5_000 + "!?" * 4_000, "größe naïve Ünïcödé 北京 안녕 123456 ½٣", "🙂🙂 <|endoftext|> \x00\x1c\x85", "der der der der", "der der der der"]


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def exact(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(vocabulary.ranks), special_tokens={})


def test_lengths_equal_the_tokenizers(spark, vocabulary, exact):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_lengths(docs, ["doc_id"], vocabulary).collect()}
    want = {r["doc_id"]: len(exact.encode_ordinary(r["text"] or "")) for r in docs.collect()}
    assert got == want and len(want) >= 1000


@pytest.mark.parametrize("share", [1e-5, 0.02, 1.1])
def test_awkward_texts(spark, vocabulary, exact, monkeypatch, share):
    """With all words hot, some, and none."""
    monkeypatch.setattr(tokens, "HOT_SHARE", share)
    rows = spark.createDataFrame(list(enumerate(AWKWARD)), "n int, text string")
    got = {r["n"]: r["n_tokens"] for r in tokens.token_lengths(rows, ["n"], vocabulary).collect()}
    assert got == {i: len(exact.encode_ordinary(t or "")) for i, t in enumerate(AWKWARD)}
    chunks = tokens.split_by_tokens(rows.selectExpr("string(n) as source", "text"), vocabulary, 7).orderBy("source", "small_chunk_idx").collect()
    text, sizes = {}, {}
    for r in chunks:
        text[r["source"]] = text.get(r["source"], "") + r["raw_text"]
        sizes.setdefault(r["source"], []).append(r["n_tokens"])
        assert len(sizes[r["source"]]) == r["small_chunk_idx"] + 1 <= r["n_chunks"]
    assert text == {str(i): t for i, t in enumerate(AWKWARD) if t}
    assert {k: sum(v) for k, v in sizes.items()} == {str(k): v for k, v in got.items() if v}
    assert sizes["9"] == sizes["10"]


def test_rows_of_a_key_count_together_and_empty_tables(spark, vocabulary):
    rows = spark.createDataFrame([(None, "a b"), (None, "c"), (1, None)], "k int, text string")
    assert {r["k"]: r["n_tokens"] for r in tokens.token_lengths(rows, ["k"], vocabulary).collect()} == {None: 3, 1: 0}
    assert tokens.token_lengths(rows.limit(0), ["k"], vocabulary).count() == 0
    assert tokens.split_by_tokens(rows.limit(0).selectExpr("string(k) as source", "text"), vocabulary).count() == 0


def test_chunks_fill_up(spark, vocabulary, exact):
    """A chunk is at most its size, as the tokenizer counts it, and the next word would not have fitted."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("string(doc_id) as source", "text")
    rows = tokens.split_by_tokens(docs, vocabulary, 50).orderBy("source", "small_chunk_idx").collect()
    assert all(r["n_tokens"] <= 50 for r in rows)
    for a, b in zip(rows, rows[1:], strict=False):
        assert len(exact.encode_ordinary(a["raw_text"])) == a["n_tokens"]
        if a["source"] == b["source"]:
            following = regex.match(public_tokenizers.PATTERN, b["raw_text"])[0]
            assert a["n_tokens"] + len(exact.encode_ordinary(following)) > 50


def test_merging_follows_ranks():
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"ab": 4, b"abc": 5, b"aa": 6, b"aaaa": 7}
    # bc goes first, then abc; aa pairs from the left, then their own pair
    assert [tokens.merged_length(w, ranks) for w in (b"abc", b"abbc", b"aaa", b"aaaaa", b"aaaabc", b"cccc")] == [1, 2, 2, 2, 3, 4]
    assert tokens.fill(np.array([3, 3, 9, 1, 1, 5]), 6) == [0, 2, 3, 5, 6]


def test_nothing_is_shuffled_but_sums(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("string(doc_id) as source", "text")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    chunks, sums = plan(tokens.split_by_tokens(docs, vocabulary)), plan(tokens.token_lengths(docs, ["source"], vocabulary))
    assert "Exchange" not in chunks and "Join" not in chunks
    assert sums.count("Exchange") == 1 and "Join" not in sums


def test_memory_of_words_is_bounded(spark, vocabulary, exact, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "KNOWN_WORDS", 3)
    known = tokens._Known("own")
    for words in (["der", " xqzzt", "der"], ["b" * 9_000], ["xqzztt", "yqzztt"], [" xqzzt"]):
        assert known.of(pa.array(words), vocabulary.ranks, 0.5).tolist() == [len(exact.encode_ordinary(w)) for w in words]
        assert len(known) <= 3 + len(words) and not any(len(w) > 99 for w in known)
