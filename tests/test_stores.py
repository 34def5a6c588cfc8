"""Stored index, bucketed stores, approximate vectors, incremental ingestion and streaming memory."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tidepool.functions.text import clean_tokens
from tidepool.operators import filters, index, search, vector_store
from tidepool.plans import ingest, retrieval
from tidepool.plans.conversation import recent_turns
from tidepool.sources import stores
from tidepool.sources.files import read_store
from tidepool.streaming import memory


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", clean_tokens(F.col("text")).alias("tokens")).cache()


@pytest.fixture(scope="module")
def asked(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), clean_tokens(F.col("text")).alias("tokens")).cache()


# index


@pytest.mark.parametrize(("group", "rows", "small"), [((), 512, 200_000), (("source",), 7, 200_000), ((), 3, 0)])
def test_index_equals_the_scan(spark, docs, asked, tmp_path, monkeypatch, group, rows, small):
    monkeypatch.setattr(index, "BLOCK_ROWS", rows)
    monkeypatch.setattr(index, "BROADCAST_ROWS", small)
    want = rows_of(search.bm25_top_k(docs, asked, 4, list(group), "doc_id").select("query_id", *group, "rank", "doc_id", "score"))
    built = index.build(docs, str(tmp_path), "doc_id", group)
    assert rows_of(index.search(built, asked, 4).select("query_id", *group, "rank", "doc_id", "score")) == want and want
    again = index.open_index(spark, str(tmp_path), "doc_id", group)
    assert rows_of(index.search(again, asked, 4).select("query_id", *group, "rank", "doc_id", "score")) == want


def test_postings_are_multiplied_in_small_tiles(spark, docs, asked, tmp_path, monkeypatch):
    """no posting becomes a row; ties, tokens of most rows and weights of 0 and below come out as in the scan."""
    for name, n in {"BLOCK_ROWS": 16, "TILE_QUERIES": 7, "TILE_BLOCKS": 3, "HELD_QUERIES": 2, "HELD_PRODUCTS": 5}.items():
        monkeypatch.setattr(index, name, n)
    monkeypatch.setattr(index, "_scores", None)
    few = spark.createDataFrame([(i, ["all", "all", "half" if i % 2 else "other", *(["x"] if i == 5 else [])]) for i in range(40)], "doc_id long, tokens array<string>")
    ask = spark.createDataFrame([(1, ["all"]), (2, ["half", "x"]), (3, ["all", "half", "half", "none"]), (4, ["none"])], "query_id long, tokens array<string>")
    for n, (rows, questions) in enumerate(((docs, asked), (few, ask))):
        want = rows_of(search.bm25_top_k(rows, questions, 4, id_col="doc_id").select("query_id", "rank", "doc_id", "score"))
        built = index.build(rows, f"{tmp_path}/{n}", "doc_id")
        assert rows_of(index.search(built, questions, 4).select("query_id", "rank", "doc_id", "score")) == want and want


def test_a_search_shuffles_only_the_best(spark, docs, asked, tmp_path, monkeypatch):
    """no row of questions or blocks is shuffled, and however many rows tie, a task gives k of them."""
    monkeypatch.setattr(index, "TILE_QUERIES", 7)
    copies = spark.range(0, 3000, 1, 3).select(F.col("id").alias("doc_id"), F.array(F.lit("same"), F.lit("words")).alias("tokens"))
    ask = spark.range(20).select(F.col("id").alias("query_id"), F.array(F.lit("words"), F.lit("none")).alias("tokens"))
    built = index.build(copies, f"{tmp_path}/copies", "doc_id")
    assert index._scanned(built, ask, 4, 1.5, 0.75, 6).count() <= 20 * 4 * 3
    got = index.search(built, ask, 4)
    assert [r["doc_id"] for r in got.where("query_id = 3").orderBy("rank").collect()] == [0, 1, 2, 3] and got.count() == 80
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()


def test_vectors_by_scan(spark, sf, monkeypatch):
    monkeypatch.setattr(search, "PASS_QUERIES", 9)
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    same = spark.range(1000, 1100).select(F.col("id").alias("vec_id"), F.array(*[F.lit(x).cast("float") for x in (0.6, 0.8, *[0.0] * 62)]).alias("embedding"))
    rows = e.union(same).union(spark.createDataFrame([(7777, None), (7778, [float("nan")] * 64)], e.schema))
    ask = e.where("vec_id % 20 = 0").union(same.limit(1)).select(F.col("vec_id").alias("query_id"), "embedding")
    want = rows_of(search.vector_top_k(rows.where("vec_id < 7000"), ask, 5, id_col="vec_id"))
    assert rows_of(search.vector_scan(rows, ask, 5, id_col="vec_id")) == want and want


def test_rounded_as_spark(spark):
    from tidepool.operators.best import rounded

    x = [0.1234565, 0.1234575, 2.0000005, -0.1234565, 1.0000015, 12.3456789, 0.0, 1e-9, 5e-7, 81.0000025]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6)).collect()]
    assert [v / 1e6 for v in rounded(np.array(x), 6).tolist()] == want


def test_index_grows(spark, docs, asked, tmp_path):
    path = str(tmp_path)
    index.build(docs.where("doc_id % 3 = 0"), path, "doc_id")
    index.build(docs.where("doc_id % 3 = 1"), path, "doc_id", mode="append")
    built = index.build(docs.where("doc_id % 3 = 2"), path, "doc_id", mode="append")
    want = rows_of(search.bm25_top_k(docs, asked, 3, id_col="doc_id").select("query_id", "rank", "doc_id", "score"))
    assert rows_of(index.search(built, asked, 3).select("query_id", "rank", "doc_id", "score")) == want


def test_blocks_that_cannot_hold_a_result_are_not_scored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_ROWS", 10)
    rows = [(i, ["common"] * (1 + i % 3) + [f"w{i}"] + (["rare", "words"] if i in (7, 300, 701) else [])) for i in range(1000)]
    built = index.build(spark.createDataFrame(rows, "doc_id long, tokens array<string>").repartition(4), str(tmp_path), "doc_id")
    q = spark.createDataFrame([(1, ["common", "rare", "words"])], "query_id long, tokens array<string>")
    p = index.plan(built, q, 3)
    assert p.bounds.count() >= 100  # every block holds the common token
    assert p.wanted.count() <= 3
    assert sorted(r["doc_id"] for r in index.search(built, q, 3).collect()) == [7, 300, 701]


def test_index_awkward(spark, tmp_path):
    rows = [("a", ["x", "x", "y"]), ("b", None), ("c", []), ("a", ["x", "x", "y"]), ("d", ["y", None]), ("e", ["x"] * 5000)]
    df = spark.createDataFrame(rows, "doc_key string, tokens array<string>")
    q = spark.createDataFrame([(1, ["x", "x"]), (2, []), (3, ["zzz"]), (4, None)], "query_id long, tokens array<string>")
    built = index.build(df, str(tmp_path / "a"))
    got = [(r["query_id"], r["rank"], r["doc_key"]) for r in index.search(built, q, 9).collect()]
    assert sorted(got) == [(1, 1, "e"), (1, 2, "a"), (1, 3, "a")] or sorted(x[2] for x in got) == ["a", "a", "e"]
    empty = index.build(df.limit(0), str(tmp_path / "b"))
    assert index.search(empty, q, 3).count() == 0


# stores


def test_store_side_is_not_shuffled(spark, sf, tmp_path, monkeypatch):
    from tidepool.plans.queries import _pages

    built = ingest.build_stores(_pages(spark, sf).limit(60), str(tmp_path))
    monkeypatch.setattr(retrieval, "LOOKED_UP", 0)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    files = built.small.select("source_md5").distinct().limit(5).checkpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for store in (built.small, built.medium):
            plan = retrieval.of_files(store, files)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange") <= 1 and "Bucketed: true" in plan  # at most the files' side
            store_side = plan[plan.index("FileScan") - 400 : plan.index("FileScan")] if "FileScan" in plan else plan
            assert "Exchange" not in store_side
        monkeypatch.setattr(retrieval, "LOOKED_UP", 1000)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        one = files.limit(1)
        plan = retrieval.of_files(built.small, one)._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = rows_of(built.small.select("source_md5", "raw_md5"))
    spark.sql(f"DROP TABLE {stores._name(f'{tmp_path}/chunks_small')}")
    assert rows_of(stores.read_bucketed(spark, f"{tmp_path}/chunks_small", "source_md5", buckets).select("source_md5", "raw_md5")) == want


def test_ways_to_the_files_agree(spark, sf, tmp_path, monkeypatch):
    from tidepool.plans.queries import QUERIES

    want = rows_of(QUERIES["three_stage"](spark, sf))
    monkeypatch.setattr(retrieval, "LOOKED_UP", 0)
    assert rows_of(QUERIES["three_stage"](spark, sf)) == want
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert rows_of(QUERIES["three_stage"](spark, sf)) == want


def test_stored_once_for_the_same_files(spark, sf, tmp_path):
    made = []
    build = lambda folder: made.append(folder) or len(made)
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert [stores.stored(spark, f"{tmp_path}/t", "x", build) for _ in range(2)] == [1, 1]
    spark.range(4).write.mode("append").parquet(f"{tmp_path}/t")
    assert stores.stored(spark, f"{tmp_path}/t", "x", build) == 2 and stores.stored(spark, f"{tmp_path}/t", "y", build) == 3


# approximate vectors


def test_vector_store(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    store = vector_store.build(e, str(tmp_path))
    exact = search.vector_top_k(e, q, 5, id_col="vec_id")
    found = vector_store.approximate_top_k(store, q, 5)
    assert vector_store.recall(found, exact) >= 0.9
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    assert all(abs(float(rows[r["query_id"]] @ rows[r["vec_id"]]) - r["score"]) < 2e-6 for r in found.collect())
    every = vector_store.approximate_top_k(store, q, 5, probes=len(store.centres), candidates=len(rows))
    assert rows_of(every.select("query_id", "vec_id", "score", "rank")) == rows_of(exact.select("query_id", "vec_id", "score", "rank"))
    assert store.rows.count() == len(rows)
    few = vector_store.approximate_top_k(store, q.limit(1), 5, probes=1)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [(cell" in plan or "PartitionFilters: [cell" in plan


def test_vector_store_awkward(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, []), (5, [None, 1.0]), (6, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    store = vector_store.build(df, str(tmp_path))
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, None)], "query_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in vector_store.approximate_top_k(store, q, 5, probes=9).collect())
    assert got == [(1, 6, 2.0), (2, 1, 1.0), (3, 1, 1.0)]
    with pytest.raises(ValueError, match="no vectors"):
        vector_store.build(df.limit(0), str(tmp_path))


# ingestion of what changed


def _chunks(spark, store):
    return {(r["source"].rpartition("/")[2], r["raw_text"]) for r in read_store(spark, f"{store}/chunks_small").collect()}


def test_only_changed_files_are_read(spark, tmp_path):
    folder, store = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    for name, text in (("a", "first text"), ("b", "second text"), ("c", "third text"), ("e", "")):
        (folder / f"{name}.txt").write_text(text)
    assert ingest.ingest_changes(spark, str(folder), store) == {"new": 3, "changed": 0, "gone": 0, "same": 0}  # an empty file has no pages
    # a change that keeps size and time shows whether an unchanged file is read
    at = os.stat(folder / "c.txt")
    (folder / "c.txt").write_text("THIRD TEXT")
    os.utime(folder / "c.txt", ns=(at.st_atime_ns, at.st_mtime_ns))
    (folder / "a.txt").write_text("first text, longer")
    (folder / "b.txt").unlink()
    (folder / "d.txt").write_text("fourth")
    counts = ingest.ingest_changes(spark, str(folder), store)
    assert (counts["new"], counts["changed"], counts["gone"]) == (1, 1, 1)
    assert _chunks(spark, store) == {("a.txt", "first text, longer"), ("c.txt", "third text"), ("d.txt", "fourth")}
    assert {r["raw_text"] for r in read_store(spark, f"{store}/chunks_medium").collect()} == {"first text, longer", "third text", "fourth"}
    assert ingest.ingest_changes(spark, str(folder), store)["new"] == 0


def test_other_parts_stay_as_they_are(spark, tmp_path):
    store = str(tmp_path)
    pages = spark.createDataFrame([(f"/d/{i}.txt", f"text {i}") for i in range(40)], "source string, text string")
    ingest.merge_pages(pages, store, parts=8)
    files = lambda: {f"{d}/{x}" for d, _, fs in os.walk(f"{store}/chunks_small") for x in fs if x.endswith(".parquet")}
    before = files()
    changed = pages.withColumn("text", F.when(F.col("source") == "/d/3.txt", "new text").otherwise(F.col("text")))
    assert ingest.merge_pages(changed, store, parts=8) == {"new": 0, "changed": 1, "gone": 0, "same": 39}
    assert len({os.path.dirname(x) for x in before ^ files()}) == 1
    assert ingest.merge_pages(changed, store, parts=8)["same"] == 40
    assert ingest.merge_pages(changed.limit(0), store, parts=8)["gone"] == 40
    assert not files()


def test_index_workers_get_bounded_batches(spark, tmp_path):
    """However many rows a task has, a worker gets few of them at once; the session's own setting stays."""
    from tidepool.operators import index

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, rows = spark.conf.get(name), 3 * 4 * index.BLOCK_ROWS
    docs = spark.range(0, rows, 1, 1).select(F.col("id").alias("doc_key"), F.array_repeat(F.lit("a"), (F.col("id") % 7 + 1).cast("int")).alias("tokens"))
    built = index.build(docs, f"{tmp_path}/index")
    # rows are in order of their lengths within a batch alone, so the shortest stand in blocks of every batch
    short = {r["block"] for r in built.blocks.where("least = 1 and token = 'a'").select("block").collect()}
    assert len(short) == 3 and spark.conf.get(name) == was
    assert built.sizes.first()["n"] == rows


def test_chunks_are_not_set_aside_to_be_merged(monkeypatch, spark, tmp_path):
    """Parts are written beside those that they replace, without a checkpoint of their chunks; parts left empty go."""
    set_aside = []
    cut = ingest.cut
    monkeypatch.setattr(ingest, "cut", lambda df: set_aside.append(df.columns) or cut(df))
    store = str(tmp_path)
    pages = spark.createDataFrame([(f"/d/{i}.txt", f"text {i}") for i in range(12)], "source string, text string")
    ingest.merge_pages(pages, store, parts=4)
    changed = pages.withColumn("text", F.when(F.col("source") == "/d/3.txt", "new text").when(F.col("source") == "/d/4.txt", "").otherwise(F.col("text")))
    ingest.merge_pages(changed, store, parts=4)
    assert _chunks(spark, store) == {(f"{i}.txt", "new text" if i == 3 else f"text {i}") for i in range(12) if i != 4}
    ingest.remove_sources(spark.createDataFrame([("/d/5.txt",)], "source string"), store)
    assert len(_chunks(spark, store)) == 10 and read_store(spark, f"{store}/chunks_medium").count() == 10
    assert not any("raw_text" in columns for columns in set_aside)


def test_files_of_folders_below_are_loaded(spark, tmp_path):
    """Folders in the folder are listed by Spark, not by a pattern on the driver, and small files share tasks."""
    from tidepool.sources import files

    for i in range(40):
        (tmp_path / "in" / f"name=doc{i}").mkdir(parents=True)
        (tmp_path / "in" / f"name=doc{i}" / "part.txt").write_text(f"text {i}")
    pages = files.load_folder(spark, str(tmp_path / "in"), below=True)
    assert {(r["source"].split("/")[-2], r["text"]) for r in pages.collect()} == {(f"name=doc{i}", f"text {i}") for i in range(40)}
    was = spark.conf.get("spark.sql.files.openCostInBytes")
    ingest.ingest_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), below=True)
    assert read_store(spark, f"{tmp_path}/out/chunks_small").count() == 40
    assert spark.conf.get("spark.sql.files.openCostInBytes") == was


def test_a_file_a_text_is_written_by_tasks(spark, tmp_path, monkeypatch):
    """a file a name in few folders, without files of checksums or a folder of its own; the files are read once."""
    from tidepool.sources import files

    rows = spark.createDataFrame([(f"doc{i}", f"téxt {i}\nof lines") for i in range(200)] + [("doc7", "again"), ("doc500", "")], "name string, value string")
    files.write_texts(rows, f"file:{tmp_path}/in")
    found = {f"{d}/{x}": d for d, _, fs in os.walk(tmp_path / "in") for x in fs}
    assert len(found) == 201 and len(set(found.values())) <= max(files.FOLDERS, 4 * spark.sparkContext.defaultParallelism)
    texts = {os.path.basename(x): open(x, encoding="utf-8").read() for x in found}
    assert texts["doc8.txt"] == "téxt 8\nof lines\n" and texts["doc500.txt"] == "\n" and sorted(texts["doc7.txt"].splitlines()) == ["again", "of lines", "téxt 7"]
    pages = files.load_folder(spark, f"{tmp_path}/in", below=True)
    assert {r["source"].rpartition("/")[2]: r["text"] for r in pages.collect()} == texts
    made = []
    own = ingest.embedded_chunks
    monkeypatch.setattr(ingest, "embedded_chunks", lambda *a: made.append(own(*a)) or made[-1])
    ingest.ingest_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out", below=True)
    columns = sorted(made[0][1].columns)
    assert rows_of(read_store(spark, f"{tmp_path}/out/chunks_medium").select(columns)) == rows_of(made[0][1].select(columns))


def test_stores_are_merged_in_rounds(spark, sf, tmp_path, monkeypatch):
    """a round replaces some parts; only texts are shuffled, and what is derived from texts isn't stored, nor needed to answer."""
    from tidepool.plans.conversation import answer_from_store, answer_turns
    from tidepool.plans.queries import _pages

    monkeypatch.setattr(ingest, "ROUND_SOURCES", 30)
    pages, rounds, plans = _pages(spark, sf), [], []
    own = ingest.files.overwrite_parts

    def overwrite(rows, path, column, parts):
        rounds.append(parts)
        plans.append(rows._jdf.queryExecution().sparkPlan().toString())
        own(rows, path, column, parts)

    monkeypatch.setattr(ingest.files, "overwrite_parts", overwrite)
    older = pages.withColumn("text", F.when(F.crc32("source") % 3 == 0, F.lit("an older text")).otherwise(F.col("text"))).where("crc32(source) % 5 <> 0")
    ingest.merge_pages(older, str(tmp_path))
    counts = ingest.merge_pages(pages, str(tmp_path))
    assert len(rounds) > 8 and len({tuple(r) for r in rounds}) >= len(rounds) // 4 and counts["new"] and counts["changed"]
    assert not any("SortMergeJoin" in p or "ShuffledHashJoin" in p for p in plans) and all(p.count("REPARTITION") <= 1 for p in plans)
    want = ingest.embedded_chunks(pages)
    for name, rows in zip(("small", "medium"), want, strict=True):
        got = read_store(spark, f"{tmp_path}/chunks_{name}")
        columns = sorted(set(rows.columns) - set(ingest.DERIVED))
        assert sorted(set(got.columns) - {"part"}) == columns
        assert rows_of(got.select(columns)) == rows_of(rows.select(columns))
    turns = spark.createDataFrame([(1, 0, "user", "hello there")], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "Human: " + " ".join(pages.orderBy("source").first()["text"].split()[:30]))], "conv_id long, question string")
    answers = rows_of(answer_from_store(asked, turns, str(tmp_path)))
    assert answers == rows_of(answer_turns(asked, turns, *want)) and answers[0][1]


# windows


def test_windows_by_brute_force(spark):
    import random

    random.seed(2)
    rows = [(f"s{i % 3}", i, lo, lo + random.choice([0, 1, 7, 40, -1])) for i in range(300) for lo in [random.randint(0, 99)]] + [("s0", 900, None, 5), ("s0", 901, 2, None)]
    points = [(f"s{random.randint(0, 3)}", random.randint(0, 140)) for _ in range(12)] * 2
    want = sorted(i for s, i, lo, hi in rows if lo is not None and hi is not None and any(p == s and lo <= c <= hi for p, c in points))
    chunks = spark.createDataFrame(rows, "source_md5 string, i int, win_lo int, win_hi int")
    centres = spark.createDataFrame(points, "source_md5 string, centre int")
    for size in (1, 8, 1000):
        assert sorted(r["i"] for r in filters.in_windows(chunks, centres, size).collect()) == want
    twice = filters.in_windows(chunks.union(chunks), centres)
    assert sorted(r["i"] for r in twice.collect()) == sorted(want * 2)


def test_a_chunk_meets_no_centre_far_away(spark):
    chunks = spark.range(100_000).select(F.lit("s").alias("source_md5"), F.col("id").cast("int").alias("win_lo"), (F.col("id") + 6).cast("int").alias("win_hi"))
    centres = spark.range(1000).select(F.lit("s").alias("source_md5"), (F.col("id") * 100).cast("int").alias("centre"))
    out = filters.in_windows(chunks, centres)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan and out.count() == 1000 * 7 - 6  # the first centre has one chunk


# memory


def test_memory_equals_the_suffix_after_every_batch(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    want = lambda: rows_of(recent_turns(spark.read.parquet(f"{tmp_path}/in"), 120).select("conv_id", "turn", "held"))
    for i in range(3):  # each start goes on from the last one's state; turns arrive out of order
        turns.where(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == i).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        memory.remember_into(stream, f"{tmp_path}/out", 120)
        assert rows_of(memory.remembered(spark, f"{tmp_path}/out").select("conv_id", "turn", "held")) == want()
