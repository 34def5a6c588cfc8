"""The pipeline's stages, each on what the one before it kept."""

import itertools
from collections import defaultdict

import corpus_pipeline
from tests.llm.test_operators import awkward, check_packing, line_model, shingle_sets
from tidepool.llm import decontaminate, packing, queries, toxicity


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, n = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == first.columns, name
        assert docs.schema.simpleString() == first.schema.simpleString(), name
        n.append(docs.count())
    assert n[1] <= n[0] and n[2] == n[1] and n[3] < n[2] and n[4] <= n[3]
    pieces = corpus_pipeline.run(spark, sf)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    empty = first.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def near_survivors(rows):
    """The least doc_id of each group of texts that five-word Jaccard of 0.8 links."""
    sets = [shingle_sets(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if group[i] != group[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
            p, q = sorted((group[i], group[j]))
            group = [p if g == q else g for g in group]
    least = defaultdict(list)
    for g, (d, _) in zip(group, rows, strict=True):
        least[g].append(d)
    return sorted(map(min, least.values()))


def clean_of(rows, bench):
    """doc_ids of texts of which windows of 13 benchmark words cover less than a twentieth."""
    windows = set()
    for text in bench:
        w = decontaminate.words_of((text or "").encode())
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    lengths = {len(x) for x in windows}
    out = []
    for d, text in rows:
        w, hit = decontaminate.words_of((text or "").encode()), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(d)
    return sorted(out)


def test_survivors_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    stages = dict(corpus_pipeline.STAGES)

    model = toxicity.fit(docs, labels)
    kept = stages["toxicity"](spark, docs, sf).cache()
    assert rows(kept) == sorted((r["doc_id"], r["text"]) for r in docs.collect() if model.score(r["text"] or "") < 0.7)

    lined = stages["line_dedup"](spark, kept, sf).cache()
    assert rows(lined) == sorted((d, t) for d, t, *_ in line_model(rows(kept)))
    assert all(r["n_chars"] == len(r["text"] or "") for r in lined.collect())

    one = stages["near_dedup"](spark, lined, sf).cache()
    ids = near_survivors(rows(lined))
    assert rows(one) == [x for x in rows(lined) if x[0] in set(ids)] and len(ids) < lined.count()

    clean = stages["decontamination"](spark, one, sf).cache()
    assert [d for d, _ in rows(clean)] == clean_of(rows(one), bench) and clean.count() < one.count()

    pieces = packing.pack(clean, queries.tokenizer_path(), with_ids=True)
    assert check_packing(clean, pieces.collect(), queries.tokenizer_path(), 2048) == 0
    same = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, stages["packing"](spark, clean, sf).select(*same).collect())) == sorted(map(tuple, pieces.select(*same).collect()))


def test_awkward_rows_through_all_stages(spark, sf):
    """Nulls, empty and long texts, repeated ids and rows, and columns that clash with the stages' own names."""
    docs = awkward(spark)
    columns = docs.columns
    extra = [c for c in columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert {r[c] for r in docs.select(*[f"`{c}`" for c in extra]).collect() for c in extra} == {"clash"}, name
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    # blank texts and copies are one document each; those without a doc_id fall to the one that has it
    assert ids == {1, 4, 5, 6, 8}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == ids
