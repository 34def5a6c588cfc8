"""Each registered query against its SQL twin, and the driver's contract."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import rows_of, rows_of_sql
from tidepool.plans.oracles import SQL
from tidepool.plans.queries import QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = rows_of(QUERIES[name](spark, sf)), rows_of_sql(duck, SQL[name])
    assert got == want
    assert got


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_all_questions_and_conversations_are_answered(spark, sf):
    ids = lambda df, c: {r[0] for r in df.select(c).distinct().collect()}
    assert ids(QUERIES["three_stage"](spark, sf), "query_id") == ids(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id")
    answers = QUERIES["answered_turns"](spark, sf).collect()
    convs = ids(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id")
    assert len(answers) == len(convs) and {r["conv_id"] for r in answers} == convs
    assert all(r["questions"] for r in answers)


def test_all_chunks_are_clustered(spark, sf):
    chunks = QUERIES["chunk_windows_fine"](spark, sf).groupBy("source").count().collect()  # the same chunks of ten words
    sets = QUERIES["interval_centroids"](spark, sf).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in sets} == {r["source"]: -(-r["count"] // 7) for r in chunks}
    assert any(r["count"] > 1 for r in sets)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_partitions_do_not_change_results(spark, sf):
    for name in ("bm25_top3", "context_assemble", "rrf_dup_text"):
        wide = rows_of(QUERIES[name](spark, sf))
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        try:
            assert rows_of(QUERIES[name](spark, sf)) == wide
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")


def bm25_model(docs, tokens):
    """doc -> score, for docs: key -> tokens, from the formula."""
    n, avg = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(t for d in docs.values() for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / max(1, len(idf))
    out = defaultdict(float)
    for key, d in docs.items():
        tf = Counter(d)
        for t in tokens:
            if t in tf:
                out[key] += (idf[t] if idf[t] >= 0 else 0.25 * mean) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / avg))
    return dict(out)


def fused_model(rows, tokens, vector, k):
    """Keys of rows (key -> tokens, embedding, raw_md5) in fused order; equal texts are one, by their last row."""
    top = lambda scores: [d for d, _ in sorted(((d, round(x, 6)) for d, x in scores.items()), key=lambda x: (-x[1], x[0]))[:k]]
    lists = [top(bm25_model({d: r["tokens"] for d, r in rows.items()}, tokens)), top({d: float(np.dot(np.array(r["embedding"], float), np.array(vector, float))) for d, r in rows.items()})]
    score, best, last = defaultdict(float), {}, {}
    for keys in lists:
        for rank, d in enumerate(keys, 1):
            h = rows[d]["raw_md5"]
            score[h] += 0.5 / (60 + rank)
            best[h] = min(best.get(h, rank), rank)
            last[h] = d
    return [last[h] for h in sorted(score, key=lambda h: (-round(score[h], 9), best[h], h))]


def three_stage_model(small, medium, questions):
    """(query, file place, file, medium chunk, rank) by plain loops; the first two rows are picked."""
    from tidepool.functions.intervals import centres

    out = []
    for q in questions:
        first = fused_model(small, q["tokens"], q["embedding"], 3)[:2]
        files = {small[d]["source_md5"]: d for d in first}  # a file's last row counts
        for place, (md5, d) in enumerate(files.items(), 1):
            inside = {x: r for x, r in small.items() if r["source_md5"] == md5}
            hits = [d] + fused_model(inside, q["tokens"], q["embedding"], 3)
            middle = centres([(small[x]["win_lo"], small[x]["win_hi"]) for x in hits])[:2]
            there = {x: r for x, r in medium.items() if r["source_md5"] == md5 and any(r["win_lo"] <= c <= r["win_hi"] for c in middle)}
            k = max(1, math.floor(1200 / 300 / len(files) / q["num_query"]))
            for rank, x in enumerate(fused_model(there, q["tokens"], q["embedding"], k)[:k], 1):
                out.append((q["query_id"], place, small[d]["file_name"], medium[x]["medium_chunk_idx"], medium[x]["raw_md5"], rank))
    return sorted(out)


def test_three_stage_by_brute_force(spark, sf):
    from pyspark.sql import functions as F

    from tidepool.functions.text import clean_tokens
    from tidepool.plans.ingest import embedded_chunks
    from tidepool.plans.queries import _pages
    from tidepool.providers import get_embedding

    small, medium = ({f"{r['source_md5']}#{r[f'{name}_chunk_idx']}": r for r in rows.collect()} for name, rows in zip(("small", "medium"), embedded_chunks(_pages(spark, sf)), strict=True))
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    asked = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("num_query"), clean_tokens(F.col("text")).alias("tokens"), get_embedding("hashing")(F.col("text")).alias("embedding")).collect()
    got = QUERIES["three_stage"](spark, sf).collect()
    want = three_stage_model(small, medium, asked)
    assert sorted((r["query_id"], r["source_pos"], r["file_name"], r["medium_chunk_idx"], r["raw_md5"], r["rank"]) for r in got) == want and want


def test_mmr_by_brute_force(spark, sf):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = []
    for q in (i for i in rows if i % 100 == 0):
        near = sorted(((-round(float(rows[q] @ v), 6), i) for i, v in rows.items()))[:20]
        left, picks = [(i, -s) for s, i in near], []
        while left and len(picks) < 5:
            value = [0.5 * s - (0.5 * max(float(rows[i] @ rows[p]) for p, _ in picks) if picks else 0) for i, s in left]
            best = max(range(len(left)), key=lambda n: (round(value[n], 9), -n))
            picks.append((left.pop(best)[0], value[best]))
        want += [(q, n, i, round(s, 6)) for n, (i, s) in enumerate(picks, 1)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in QUERIES["mmr"](spark, sf).collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)]
    assert np.allclose([x[3] for x in got], [x[3] for x in sorted(want)], atol=2e-6)


def centres_model(intervals):
    """By the rules; of equal intervals the one that stands first leaves first."""
    rest, out = list(intervals), []
    middle = lambda x: -(-(x[0] + x[1]) // 2)
    while rest:
        x, inside = [rest[0]], None
        rest = rest[1:]
        for i in list(rest):
            for g in x:
                if max(g[0], i[0]) <= min(g[1], i[1]):
                    inside = i if g[0] <= i[0] and i[1] <= g[1] else inside
                    x.append(i)
                    rest.remove(i)
                    break
        if inside is not None:
            out.append(middle(inside))
        elif len(x) > 2:
            begin, end = min(x[0][1], x[1][1]), max(x[-1][0], x[-2][0])
            end = end if end <= min(x[-1][1], x[-2][1]) else begin
            out += sorted(range(min(begin, end), max(begin, end) + 1), reverse=begin > end)
        else:
            out.append(round(sum(map(middle, x)) / len(x)))
    return out


def test_interval_centroids_by_brute_force(spark, sf):
    import hashlib

    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words = (r["text"] or "").split()
        texts = [" ".join(words[i : i + 10]) for i in range(0, len(words), 10)]
        lo, hi, held, window = {}, {}, [], 0
        for i in range(len(texts)):  # windows as they slide: at most 18 chunks are held, three leave at once
            if i and i % 3 == 0 and i + 18 < len(texts):
                window += 1
            held.append((i, window))
            if len(held) > 18:
                held = held[3:]
            lo[i], hi[i] = held[0][1], window
        order = sorted(range(len(texts)), key=lambda i: (hashlib.md5(texts[i].encode()).hexdigest(), i))
        for n in range(0, len(order), 7):
            want[f"/docs/{r['source']}/{r['doc_id']}.txt", n // 7] = ",".join(map(str, centres_model([(lo[i], hi[i]) for i in order[n : n + 7]])))
    got = {(r["source"], r["set_no"]): r["centres"] for r in QUERIES["interval_centroids"](spark, sf).collect()}
    assert got == want


def test_answered_turns_by_parts(spark, sf):
    """The stub asks the input back, so each turn's context is that of the three-stage search with its question."""
    import hashlib

    from pyspark.sql import functions as F

    from tidepool.functions.text import clean_tokens
    from tidepool.plans import conversation
    from tidepool.plans.ingest import embedded_chunks
    from tidepool.plans.queries import _pages
    from tidepool.providers import get_embedding

    got = {r["conv_id"]: r for r in QUERIES["answered_turns"](spark, sf).collect()}
    last = {r["conv_id"]: r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")).collect()}
    small, medium = ({f"{r['source_md5']}#{r[f'{name}_chunk_idx']}": r for r in rows.collect()} for name, rows in zip(("small", "medium"), embedded_chunks(_pages(spark, sf)), strict=True))
    some = sorted(got)[:6]
    asked = [(c, p, q) for c in some for p, q in enumerate(got[c]["questions"].split("|"))]
    table = spark.createDataFrame([(c, p, f"{c}:{p}", q, len(got[c]["questions"].split("|"))) for c, p, q in asked], "conv_id long, question_pos int, query_id string, q string, num_query int")
    questions = table.select("*", clean_tokens(F.col("q")).alias("tokens"), get_embedding("hashing")(F.col("q")).alias("embedding")).collect()
    for c in got:
        assert got[c]["questions"].split("|")[0] in last[c].replace("\r", " ").replace("\n", " ")
    for c in some:
        mine = [q for q in questions if q["conv_id"] == c]
        pos = {q["query_id"]: q["question_pos"] for q in mine}
        rows = [(c, pos[q], place, name, i, h, next(r["raw_text"] for r in medium.values() if r["raw_md5"] == h), rank) for q, place, name, i, h, rank in three_stage_model(small, medium, mine)]
        found = spark.createDataFrame(rows, "conv_id long, question_pos int, source_pos int, file_name string, medium_chunk_idx int, raw_md5 string, raw_text string, rank int")
        context = conversation.assemble(conversation.place_files(found), ("conv_id",)).first()["context"] if rows else ""
        assert got[c]["context_md5"] == hashlib.md5(context.encode()).hexdigest()


def test_a_question_that_repeats_the_input_is_searched_once(spark, sf, monkeypatch):
    """the hits of the typed input are those of a question with its tokens."""
    from tidepool.plans import conversation

    searched = []
    own = conversation.lexical_hits
    monkeypatch.setattr(conversation, "lexical_hits", lambda small, lexical, queries, k: searched.append(queries.count()) or own(small, lexical, queries, k))
    rows = QUERIES["answered_turns"](spark, sf).collect()
    asked = sum(len(r["questions"].split("|")) for r in rows)
    assert searched[0] == len(rows) and sum(searched[1:]) < asked


def test_hashed_embedding_by_brute_force(spark, sf):
    import zlib

    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in QUERIES["hashed_embedding"](spark, sf).collect():
        v = np.zeros(64)
        for w in texts[r["item_id"]].lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >= 2**31 else -1
        assert abs(r["first"] - v[0] / np.linalg.norm(v)) < 2e-6 and abs(r["norm"] - 1) < 1e-5


def test_stores_that_cannot_be_read_hold_nothing(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from tidepool.plans.conversation import answer_from_store

    turns = spark.createDataFrame([(1, 0, "user", "hello there")], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "Human: what is it?")], "conv_id long, question string")
    broken = tmp_path / "store" / "chunks_small"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"no parquet at all")
    for store in ("nowhere", "store"):
        out = answer_from_store(asked, turns, str(tmp_path / store)).collect()
        assert [(r["conv_id"], r["context"], r["questions"]) for r in out] == [(1, "", ["what is it?"])]


