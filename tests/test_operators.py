"""Chunks, filters, search, retrieval and conversation on small inputs."""

from collections import deque

import pytest
from pyspark.sql import functions as F

from tidepool.config import Config
from tidepool.operators import chunking, filters, search
from tidepool.plans import conversation, ingest, retrieval
from tidepool.providers import first_rows, get_embedding, get_model
from tidepool.sources import files


def pages(spark, n_words, source="/d/a.txt"):
    return spark.createDataFrame([(source, " ".join(f"w{i}" for i in range(n_words)))], "source string, text string")


def window_model(n, steps, size):
    """Windows held by each chunk, counted one by one."""
    held, number, out = deque(), 0, []
    for i in range(n):
        number += i > 0 and i % steps == 0 and i < n - size
        held.append(number)
        if len(held) > size:
            for _ in range(steps):
                held.popleft()
        out.append((min(held), max(held)))
    return out


@pytest.mark.parametrize("n", [0, 1, 5, 18, 19, 21, 22, 40, 60])
@pytest.mark.parametrize(("steps", "size"), [(3, 18), (2, 7), (1, 1)])
def test_windows(spark, n, steps, size):
    rows = chunking.add_windows(chunking.split_by_words(pages(spark, n), 1), steps, size).orderBy("small_chunk_idx").collect()
    assert [(r["win_lo"], r["win_hi"]) for r in rows] == window_model(n, steps, size)


def test_windows_must_fit(spark):
    with pytest.raises(ValueError):
        chunking.add_windows(chunking.split_by_words(pages(spark, 3), 1), 4, 3)


def test_chunks_number_through_pages(spark):
    p = spark.createDataFrame([("s", 1, "a b c"), ("s", 0, "d e"), ("s", 2, ""), ("t", 0, None)], "source string, page int, text string")
    rows = chunking.split_by_words(p, 2).orderBy("small_chunk_idx").collect()
    assert [(r["page"], r["raw_text"], r["n_chunks"]) for r in rows] == [(0, "d e", 3), (1, "a b", 3), (1, "c", 3)]


def test_merged_text_is_all_text(spark):
    small = chunking.add_windows(chunking.split_by_words(pages(spark, 50), 7))
    medium = chunking.merge_chunks(small)
    join = lambda df, i: "".join(r["raw_text"] for r in df.orderBy(i).collect())
    assert join(small, "small_chunk_idx") == join(medium, "medium_chunk_idx")


def test_recursive_split():
    size = lambda s: len(s.split())
    text = "a b c\n\nd e\nf g h i j\n\nk"
    out = chunking.recursive_split(text, 3, 0, size)
    assert out == ["a b c", "d e", "f g h", "i j", "k"]
    assert all(size(x) <= 3 for x in chunking.recursive_split(text, 3, 1, size))


def test_recursive_split_table(spark):
    got = chunking.split_recursively(pages(spark, 10), 4).orderBy("small_chunk_idx").collect()
    assert [r["raw_text"] for r in got] == ["w0 w1 w2 w3", "w4 w5 w6 w7", "w8 w9"]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "a", 9), (3, "a", 9)], "id int, k string, n int")
    ids = lambda tree, **o: sorted(r["id"] for r in filters.apply_filter(df, tree, **o).collect())
    assert ids({"k": ("==", "a"), "n": (">", 5)}) == [3, 3]
    assert ids({"k": ("==", "a")}, distinct=True) == [1, 3]
    assert ids({"OR": [{"n": ("<=", 5)}, {"k": ("==", "b")}]}) == [1, 2]
    assert ids({"AND": [{"n": (">=", 5)}, {"OR": [{"id": ("<", 2)}, {"id": ("==", 3)}]}], "OR": [{"id": ("==", 2)}]}) == [1, 3, 3]
    assert ids({"AND": []}) == []
    assert ids({"k": ("==", "no"), "n": (">", 5)}) == []
    assert ids({"k": ("==", "no"), "n": (">", 5)}, empty_predicate="ignore") == [3, 3]
    assert ids({"k": ("==", "no")}, empty_predicate="ignore") == []
    with pytest.raises(ValueError):
        filters.compile_filter({"OR": []})
    with pytest.raises(ValueError):
        filters.compile_filter({"k": ("!=", 1)})


def test_filter_reaches_the_scan(spark, sf):
    df = filters.apply_filter(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars"), {"n_chars": (">", 100)})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]


def test_fusion_by_hand(spark):
    rows = lambda *names: spark.createDataFrame([(1, n, i + 1, f"{n}{k}") for i, (n, k) in enumerate(names)], "query_id int, raw_md5 string, rank int, doc string")
    a, b = rows(("A", 0), ("B", 0)), rows(("B", 1), ("C", 1))
    out = search.fuse([a, b], (0.5, 0.5), ["query_id"], payload=["doc"]).orderBy("rank").collect()
    assert [(r["raw_md5"], r["doc"]) for r in out] == [("B", "B1"), ("A", "A0"), ("C", "C1")]
    with pytest.raises(ValueError):
        search.fuse([a], (0.5, 0.5), ["query_id"])


def test_bm25_prefix(spark, sf):
    from tidepool.plans.queries import _bm25_docs, _questions

    docs, q = _bm25_docs(spark, sf), _questions(spark, sf)
    key = lambda df: {(r["query_id"], r["rank"]): r["doc_id"] for r in df.collect()}
    three, five = key(search.bm25_top_k(docs, q, 3, id_col="doc_id")), key(search.bm25_top_k(docs, q, 5, id_col="doc_id"))
    assert three.items() <= five.items()


def test_mmr_by_hand(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.999, 0.0447]), (3, [0.8, 0.6]), (4, None)], "doc_key int, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, embedding array<float>")
    out = search.mmr(docs, q, 2, 3).orderBy("rank").collect()
    assert [r["doc_key"] for r in out] == [1, 2] or [r["doc_key"] for r in out] == [1, 3]
    assert search.mmr(docs, q, 2, 3, balance=0.1).orderBy("rank").collect()[1]["doc_key"] == 3
    assert search.vector_top_k(docs, q.where("query_id = 0"), 2).count() == 0


def test_selection(spark):
    s = spark.createDataFrame([(1, 1, "x", "A"), (1, 2, "y", "B"), (1, 3, "z", "A")], "query_id int, rank int, raw_text string, source_md5 string").withColumn("source", F.col("source_md5"))
    ids = lambda *i: lambda prompt: F.array(*[F.lit(x) for x in i]).cast("array<int>")
    got = lambda *i, **o: [(r["source_md5"], r["raw_text"]) for r in retrieval.select_rows(s, s, ids(*i), **o).orderBy("source_pos").collect()]
    assert got(0, 1, 2) == [("A", "z"), ("B", "y")]
    assert got(0, 1, 2, per_source="first") == [("A", "x"), ("B", "y")]
    assert got(9) == [("A", "x")]
    assert got() == []


def stores(spark):
    embed = get_embedding("hashing")
    rows = [(f"/d/f{i}.txt", " ".join(f"{'apple' if i == 2 and 500 < w < 530 else 'word'}{(w * 7 + i) % 97}" for w in range(1200))) for i in range(4)]
    small, medium = ingest.chunk(spark.createDataFrame(rows, "source string, text string"), Config(base_chunk_size=20))
    return [c.withColumn("embedding", embed(F.col("embed_text"))).cache() for c in (small, medium)]


def test_a_turn(spark):
    small, medium = stores(spark)
    asked = spark.createDataFrame([(1, "Human: where is apple80 and apple18"), (2, "word5")], "conv_id int, question string")
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id int, turn int, role string, text string")
    out = {r["conv_id"]: r for r in conversation.answer_turns(asked, turns, small, medium, Config(base_chunk_size=20), first_rows(1)).collect()}
    assert out[1]["questions"] == ["where is apple80 and apple18"]
    assert "Context about f2.txt" in out[1]["context"] and "apple80" in out[1]["context"]
    assert set(out) == {1, 2}


def test_assemble(spark):
    rows = [(0, "a", 0, 1, 5, "m1", "t1"), (0, "a", 1, 1, 5, "m1", "t1"), (1, "b", 0, 1, 3, "m1", "t1"), (1, "b", 0, 2, 1, "m2", "t2"), (2, "c", 0, 1, 1, "m2", "t2")]
    df = spark.createDataFrame(rows, "file_pos int, file_name string, question_pos int, pos int, medium_chunk_idx int, raw_md5 string, raw_text string")
    text = lambda **o: conversation.assemble(df, **o).first()["context"]
    assert text() == "\nContext about a:\n{t1\nt1}\n\nContext about b:\n{t2}\n\nContext about c:\n{}\n"
    assert text(dedup_within_file=True) == "\nContext about a:\n{t1}\n\nContext about b:\n{t2}\n\nContext about c:\n{}\n"


def test_config(tmp_path):
    (tmp_path / "c.ini").write_text("[a]\nMODEL_NAME = x%y\nTEMPURATURE = 0.5\nRETRIEVER_WEIGHTS = 0.3, 0.7\n[b]\nWINDOW_STEPS=2\nLOGGING = False\n")
    c = Config.from_ini(str(tmp_path / "c.ini"))
    assert (c.model_name, c.temperature, c.retriever_weights, c.window_steps, c.logging) == ("x%y", 0.5, (0.3, 0.7), 2, False)
    with pytest.raises(ValueError):
        Config(window_steps=19)
    with pytest.raises(ValueError):
        Config(retriever_weights=(1.0,))


def test_registries():
    with pytest.raises(ValueError):
        get_model("unknown")
    with pytest.raises(ValueError):
        get_embedding("unknown")


def test_folder_to_stores(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.txt").write_text("one two three\nfour")
    (tmp_path / "in/a.txt").write_text("five")
    ingest.ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), Config(base_chunk_size=2))
    ingest.ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), Config(base_chunk_size=2))
    small = files.read_store(spark, str(tmp_path / "out/chunks_small"))
    assert sorted(r["raw_text"] for r in small.collect()) == ["five", "one two", "three four"]
    assert sorted(r[0] for r in files.read_store(spark, str(tmp_path / "out/file_names")).collect()) == ["a.txt", "b.txt"]
    (tmp_path / "in/c.doc").write_text("x")
    with pytest.raises(ValueError, match="doc not supported"):
        files.load_folder(spark, str(tmp_path / "in"))
    assert files.load_folder(spark, str(tmp_path / "in"), "skip").count() == 2


def test_streamed_folder(spark, tmp_path):
    from tidepool.streaming.ingest import watch_text_folder

    (tmp_path / "in").mkdir()
    for n, text in (("a", "one two three"), ("b", "four")):
        (tmp_path / f"in/{n}.txt").write_text(text)
        watch_text_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), Config(base_chunk_size=2)).awaitTermination()
    small = spark.read.parquet(str(tmp_path / "out/chunks_small"))
    assert sorted(r["raw_text"] for r in small.collect()) == ["four", "one two", "three"]


def test_scores_of_few_questions_are_held_at_once(monkeypatch, spark):
    """A tile's scores come a block of questions at a time, and the result is that of all at once."""
    import random

    from tests.conftest import rows_of

    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], i % 3) for i in range(40)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
    asked = docs.withColumnRenamed("vec_id", "query_id")
    want = {f: rows_of(search.vector_top_k(docs, asked, 3, id_col="vec_id", file_col=f)) for f in (None, "label")}
    monkeypatch.setattr(search, "BLOCK_QUERIES", 7)
    for f, rows in want.items():
        assert rows_of(search.vector_top_k(docs, asked, 3, id_col="vec_id", file_col=f)) == rows
    assert len(want["label"]) == 120
