"""Each corpus operator against brute force or its law, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of, rows_of_sql
from tidepool.llm import chat, decontaminate, line_dedup, packing, queries, secrets, sharding, shingles, simhash, suffix_dedup, top_k, toxicity
from tidepool.llm.oracles import SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def docs_of(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts, first)], DOCS)


def awkward(spark):
    """Nulls, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    long = " ".join(f"w{i % 977}" for i in range(30_000)) + "\n" + "z" * 70_000
    shared = "a line that several documents share with each other and then some more of it"
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, " \t\n\n ", "en", "s"), (4, long, "en", "s"), (5, shared, "en", "s"), (5, shared, "en", "s"), (5, f"{shared}\nother", "de", "t"), (6, f"x\n{shared}\n{shared}", "en", "s"), (None, shared, "en", "s"), (7, long, "fr", "u"), (8, "password = hunter22!", "en", "s")]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    for extra in ("key", "row_key", "start", "end", "n_dropped", "score", "fp", "component_id", "node", "h1", "words", "spans", "kept_text", "value", "n_lines", "__id", "__key", "__doc", "__bad", "__row_key", "id", "row", "keep", "label", "bad_doc", "_bad_doc", "__score"):
        df = df.withColumn(extra, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = rows_of(queries.QUERIES[name](spark, sf))
    assert got == rows_of_sql(duck, SQL[name]) and got


# line dedup


def line_model(rows):
    keys = defaultdict(set)
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for d, t in rows:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= 10:
                keys[key(line)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and key(x) in keys and min(keys[key(x)]) < d for x in lines]
        out.append((d, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [0, 3, 1_000_000])
def test_lines(spark, hot):
    random.seed(hot)
    pool = ["", "short", "A line of ten", "a LINE of ten ", "\x0banother long line", "éÉ long enough line", "unique"] + [f"common line {i}" for i in range(5)]
    texts = ["\n".join(random.choice(pool) for _ in range(random.choice([0, 1, 3, 200]))) for _ in range(60)]
    df = docs_of(spark, texts)
    got = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, hot_lines=hot)).select("row.doc_id", "kept_text", "n_lines", "n_dropped")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == line_model([(i, t) for i, t in enumerate(texts, 1)])


def test_lines_awkward(spark):
    df = awkward(spark)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and {r["n_lines"] for r in out.collect()} == {"clash"}
    want = line_model([(r["doc_id"], r["text"]) for r in df.collect()])
    plain = df.select("doc_id", "text")
    got = line_dedup.apply_bitmaps(plain, line_dedup.keep_bitmaps(plain)).select("row.doc_id", "kept_text", "n_lines", "n_dropped")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_keep_bitmaps_are_sparse(spark):
    first = "\n".join(f"line number {i} of many" for i in range(200))
    texts = [first, "\n".join([f"own line {i} of this text" for i in range(130)] + ["line number 7 of many"]), "line number 5 of many\nline number 6 of many", "no such line here"]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], [tuple(x) for x in r["keep"]]) for r in line_dedup.keep_bitmaps(docs_of(spark, texts)).collect()}
    assert got == {1: (200, 0, []), 2: (131, 1, [(2, 3)]), 3: (2, 2, [(0, 0)]), 4: (1, 0, [])}
    many = docs_of(spark, [first, "a first line of its own\n" + "\n".join(first.split("\n")[:100])])
    bits = {r["doc_id"]: [tuple(x) for x in r["keep"]] for r in line_dedup.keep_bitmaps(many).collect()}
    assert bits[2] == [(0, 1), (1, 0)]
    for n in (1, 63, 64, 65, 127):  # a last word of any length
        lines = [f"a line number {i} here" for i in range(n)]
        out = line_dedup.keep_bitmaps(docs_of(spark, [lines[-1], "\n".join(lines)])).where("doc_id = 2").first()
        assert (out["n_lines"], out["n_dropped"]) == (n, 1) and [tuple(x) for x in out["keep"]] == [((n - 1) // 64, (1 << (n - 1) % 64) - 1 if n % 64 else 2**63 - 1)]


# decontamination


def test_fm_index_by_brute_force():
    random.seed(3)
    for _ in range(150):
        vocab = [b"a", b"b", b"c", b"dd", b"\xc3\xa9"][: random.randint(1, 5)]
        text = lambda n: b" ".join(random.choice(vocab + [b"zz"] * (random.random() < 0.3)) for _ in range(n))  # noqa: B023, E731
        items = [(i, text(random.randint(0, 9))) for i in range(random.randint(0, 5))]
        docs, size = [text(random.randint(0, 40)) for _ in range(random.randint(1, 6))], random.randint(1, 5)
        w = decontaminate.Windows(items, size)
        ids = [np.array([w.vocab.get(x, 0) for x in decontaminate.words_of(t)], np.int32) for t in docs]
        for t, (spans, found) in zip(docs, decontaminate.search_shard(ids, w), strict=True):
            ws, hit, names = decontaminate.words_of(t), set(), set()
            for i, item in items:
                x = decontaminate.words_of(item)
                for k in range(max(1, len(x) - size + 1) if x else 0):
                    for p in range(len(ws)):
                        if ws[p : p + len(x[k : k + size])] == x[k : k + size]:
                            hit.update(range(p, p + len(x[k : k + size])))
                            names.add(i)
            assert {p for a, b in spans for p in range(a, b)} == hit and found == sorted(names)


def test_a_large_block_of_windows_is_small():
    """A benchmark of 4 MB: what is broadcast, and the peak while it is built, for each byte of text."""
    import pickle
    import tracemalloc

    rng = random.Random(1)
    words = [f"w{i}" for i in range(50_000)]
    items = [(i, " ".join(rng.choices(words, k=700)).encode()) for i in range(1000)]
    text = sum(len(t) for _, t in items)
    tracemalloc.start()
    w = decontaminate.Windows(iter(items))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.lengths) > 600_000
    assert len(pickle.dumps(w)) < 6 * text and peak < 60 * text


def test_blocks_of_benchmark_agree(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = rows_of(decontaminate.find_contamination(docs, bench))
    import unittest.mock as mock

    with mock.patch.object(decontaminate, "cut", lambda df: df):
        big = bench.withColumn("text", F.concat("text", F.lit(" "), F.repeat(F.lit("§"), 8000)))  # words beyond ASCII that no document has
        many = decontaminate.find_contamination(docs, bench, block_mb=32)
        assert rows_of(many) == one
        assert decontaminate.find_contamination(docs, big, block_mb=1).count() == docs.count()


def test_decontaminate_awkward(spark):
    df = awkward(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "hunter22"), (4, "Password HUNTER22"), (4, "password hunter22"), (5, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    found = decontaminate.judge(decontaminate.find_contamination(df, bench))
    assert {(r["doc_id"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in found.collect() if r["n_hit"]} == {(4, 620, (5,), False), (7, 620, (5,), False), (8, 2, (4,), True)}
    assert found.count() == df.count()
    kept = decontaminate.decontaminate(df, bench)
    assert {r["__key"] for r in kept.collect()} == {"clash"}
    assert kept.columns == df.columns and kept.count() == df.count() - 1
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == df.count()
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


# suffix-array dedup


def test_suffix_order():
    random.seed(5)
    for _ in range(800):
        s = [random.randint(1, random.randint(1, 4)) for _ in range(random.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])  # noqa: B023


def span_model(rows, span):
    out = []
    for d, t in rows:
        t, gone = (t or "").encode(), set()
        for i in range(len(t) - span + 1):
            if d is not None and any(d2 is not None and d2 < d and t[i : i + span] in (t2 or "").encode() for d2, t2 in rows):
                gone.update(range(i, i + span))
        runs = sum(1 for p in gone if p - 1 not in gone)
        out.append((d, len(t), len(gone), runs, bytes(b for p, b in enumerate(t) if p not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_substrings(spark, seed):
    random.seed(seed)
    letters, span = random.choice(["ab", "abcé", "abcdefghijklmnopqrstuvwxyz "]), random.choice([17, 33, 50])
    pool = ["".join(random.choice(letters) for _ in range(random.randint(10, 120))) for _ in range(6)]
    texts = []
    for _ in range(40):
        t = "".join(random.choice(pool) if random.random() < 0.7 else "".join(random.choice(letters) for _ in range(20)) for _ in range(random.randint(0, 6)))
        if t and random.random() < 0.5:
            p = random.randrange(len(t))
            t = t[:p] + random.choice(letters) + t[p + 1 :]
        texts.append(t)
    df = docs_of(spark, texts).repartition(5)
    got = suffix_dedup.dedup_substrings(df, span).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert sorted((tuple(r[:4]) + (bytes(r[4]),) for r in got.collect()), key=repr) == span_model([(i, t) for i, t in enumerate(texts, 1)], span)


def test_long_text_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    random.seed(1)
    text = bytes(random.choice(b"abcd") for _ in range(3_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([text], pa.binary())], names=["a", "b", "c"])
    covered = []
    for b in suffix_dedup._find_runs(50)(iter([batch])):
        start, count, _, _ = suffix_dedup._unpack(b.column(3).to_numpy())
        covered += [p for s, n in zip(start, count, strict=True) for p in range(s, s + n)]
    assert sorted(covered) == list(range(len(text) - 49))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_unlike_texts_of_one_id_keep_their_own_bytes(spark, monkeypatch, broadcast):
    import xxhash

    monkeypatch.setattr(suffix_dedup, "REPEATED_IDS", broadcast)
    first = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(240))
    bits = xxhash.xxh64_intdigest(first, seed=42) & 0xFFFF
    other = next(t for i in itertools.count() if xxhash.xxh64_intdigest(t := f"{i} " + "".join(chr(65 + (j * j + 3 * j + i) % 26) for j in range(240)), seed=42) & 0xFFFF == bits)
    rows = [(1, first), (2, first), (2, other), (2, other), (3, "short")]
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], bytes(r["kept"]).decode()) for r in got) == sorted([(1, 0, first), (2, 240, ""), (2, 0, other), (2, 0, other), (3, 0, "short")])


def test_substrings_awkward(spark):
    df = awkward(spark)
    want = [(d, n, g, r, sha(k)) for d, n, g, r, k in span_model([(r["doc_id"], r["text"]) for r in df.where("doc_id <> 4 and doc_id <> 7 or doc_id is null").collect()], 50)]
    got = suffix_dedup.dedup_substrings(df)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in got.where("doc_id <> 4 and doc_id <> 7 or doc_id is null").collect()), key=repr) == sorted(want, key=repr)
    whole = got.where("doc_id = 7").first()
    assert whole["n_removed"] == whole["n_bytes"] and whole["n_spans"] == 1
    assert suffix_dedup.dedup_substrings(df.limit(0)).count() == 0


# sharding


def kd_model(docs, shards):
    """(doc_id, text) -> shard by sorting each node whole; docs has doc_id, text, lang, source."""
    import xxhash

    h = lambda x: xxhash.xxh64_intdigest(x.encode(), 42)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    long = lambda x, seed: xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed)
    rows = []
    for d, t, lang, source in docs:
        size = len((t or "").encode()) + 1
        name = lambda x: 0 if x is None else 1 + signed(h(x)) % 4095
        rows.append({"id": d, "text": t, "size": size, "key": signed(h(t or "")), "bins": [name(lang), name(source), min(4095, int(math.floor(math.log2(size) * 64)))]})
    total = sum(r["size"] for r in rows)
    together = max(max(r["size"] for r in rows), total / shards / 20)
    for i in range(3):
        by = defaultdict(int)
        for r in rows:
            by[r["bins"][i]] += r["size"]
        upto, place = 0, {}
        for b in sorted(by):
            upto += by[b]
            place[b] = math.floor((upto - by[b] / 2) / total * 4095)
        for r in rows:
            r.setdefault("dims", []).append(place[r["bins"][i]])
    groups = defaultdict(list)
    for r in rows:
        groups[r["key"]].append(r)
    for own in groups.values():
        least, apart = [min(r["dims"][i] for r in own) for i in range(3)], sum(r["size"] for r in own) > together
        for r in own:
            r["least"] = least
            seed = 42 if r["id"] is None else long(r["id"], 42)
            r["tie"] = ((r["key"] % 2**24) << 16) + (signed(long(r["key"], seed)) % 65536 if apart else 0)
    out = []

    def split(own, leaves, first):
        if leaves == 1 or not own:
            out.extend((r["id"], r["text"], first) for r in own)
            return
        width = [max(r["least"][i] for r in own) - min(r["least"][i] for r in own) for i in range(3)]
        dim = width.index(max(width))
        blocks = defaultdict(list)
        for r in own:
            blocks[r["least"][dim], r["tie"]].append(r)
        want, left, sides = sum(r["size"] for r in own) * (leaves // 2) / leaves, 0, ([], [])
        done = False
        for key in sorted(blocks):
            size = sum(r["size"] for r in blocks[key])
            goes_left = not done and (left + size <= want or left + size / 2 <= want)
            done = done or left + size > want
            left += size
            sides[0 if goes_left else 1].extend(blocks[key])
        split(sides[0], leaves // 2, first)
        split(sides[1], leaves - leaves // 2, first + leaves // 2)

    split(rows, shards, 0)
    return sorted(out, key=repr), together


def test_shards(spark, sf):
    rng = random.Random(6)
    made = [(i, "x" * int(math.exp(rng.uniform(0, 7))) + (str(i) if rng.random() < 0.7 else ""), rng.choice(["en", "en", "de", None]), f"s{rng.randrange(9)}") for i in range(600)]
    made += [(1000 + i, "one hot text " * 9, "en", "s1") for i in range(200)] + [(None, None, None, None), (2, "", "en", "s0"), (2, "", "en", "s0")]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    for docs, shards in ((made, 16), (made, 5), ([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table.collect()], 16), ([(1, "a", "en", "s")], 16)):
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
        rows = sharding.shard_by_kd_tree(df, shards).collect()
        want, together = kd_model(docs, shards)
        assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in rows if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), s) for d, t, s in want if d is not None)
        assert len(rows) == len(docs)
        size, slots, of_text = defaultdict(int), defaultdict(list), defaultdict(lambda: [0, set()])
        for r in rows:
            size[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            of_text[r["text_crc32"]][0] += r["size"]
            of_text[r["text_crc32"]][1].add(r["shard"])
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert all(len(where) == 1 for b, where in of_text.values() if b <= together)
        # a cut misses the median by half a block at most, and a leaf's share of that halves with each level above
        assert all(abs(size[s] - sum(size.values()) / shards) <= together for s in range(shards))


def test_shards_by_target_bytes(spark):
    df = docs_of(spark, [f"{i:09d}" for i in range(1000)])  # ten bytes each
    sizes = [r["b"] for r in sharding.shard_by_kd_tree(df, target_bytes=1000).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 10 and all(990 <= b <= 1010 for b in sizes)
    with pytest.raises(ValueError, match="over"):
        sharding.shard_by_kd_tree(df, shards=sharding.MOST_LEAVES + 1)


def test_widest_dimension_can_be_size(spark):
    """With one language and one source, size is the only dimension that can part documents."""
    df = spark.createDataFrame([(i, "x" * i, "en", "s") for i in range(1, 400)], "doc_id long, text string, lang string, source string")
    rows = sharding.shard_by_kd_tree(df, 4).collect()
    spans = sorted((min(x), max(x)) for x in [[r["size"] for r in rows if r["shard"] == s] for s in range(4)])
    assert all(a[1] <= b[0] + 20 for a, b in zip(spans, spans[1:], strict=False))


def test_shards_awkward(spark):
    df = awkward(spark)
    assert sharding.shard_by_kd_tree(df, 3).count() == df.count()
    assert sharding.shard_by_kd_tree(df.limit(0)).count() == 0


# secrets


def secret_model(text):
    text = text or ""
    out = []
    for m in re.finditer(secrets.PATTERNS["assign"], text, re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for kind, pattern, least in (("access", r"AKIA[A-Z0-9]+", 20), ("hex", r"[0-9a-f]+", 24)):
        out += [(m.start(), secrets.KINDS.index(kind), f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return ",".join(x[2] for x in sorted(out))


def test_base_secrets(spark):
    random.seed(2)
    parts = ["secret:token:abcdefgh", "PASSWORD = 'x1y2z3'", "api_key=\"short\"", "apikey : aaaaaaaaaaaa", "AKIAKIA" + "A" * 14, "AKIA" + "B" * 15, "ab" * 12, "ab" * 11, "é", "token=token=abcdef", "passwd=secret=", "\U0001f600", "\n", "'", "=", "password", " "]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(150)]
    got = {r["doc_id"]: r["base_sha256"] for r in secrets.secrets_by_document(docs_of(spark, texts)).collect()}
    assert got == {i: sha(secret_model(t)) for i, t in enumerate(texts, 1)}


def test_all_spans_by_brute_force(spark):
    """Every kind, whether a value looks random, and how many owners and repositories hold it."""
    token, pem = r"(?:gh[opsu]|xox[abprs]|[spr]k)[_-][A-Za-z0-9_-]{16,}", "-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rng = random.Random(9)
    values = [f"{rng.choice(['ghp_', 'sk-', 'xoxb-'])}{''.join(rng.choice('aB3dE5gH7') for _ in range(20))}" for _ in range(5)] + ["password=Zx81kLq0", "secret: changeme12", "AKIA" + "Q7Z1" * 4, "0a1b2c3d" * 3, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "sk_" + "a" * 20]
    rows = []
    for i in range(1, 91):
        own = rng.sample(values[:3] + values[5:], rng.randrange(0, 3)) if i > 30 else [values[3]]  # one value in 30 documents of one owner
        rows.append((i, " ".join(own + (["é", values[4]] if i in (60, 61) else [])), "en", "s0" if i <= 30 else f"s{rng.randrange(1, 4)}", 0))

    def random_looking(v):
        return len(v) >= 8 and re.search("[0-9]", v) and re.search("[A-Za-z]", v) and not re.search(r"(?i)example|changeme|placeholder|dummy|your|xxxx|\*\*\*|1234567|abcdef", v) and len(set(v)) >= 6

    found, owners, repos = defaultdict(list), defaultdict(set), defaultdict(set)
    for d, t, _, o, _ in rows:
        for k, pattern in enumerate((secrets.PATTERNS["assign"], r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", token, pem)):
            for m in re.finditer(pattern, t, re.ASCII):
                v = m[2] if k == 0 else m[0]
                if k or len(v) >= 6:
                    found[d].append((m.start(), k, m.end(), v))
                    owners[v].add(o)
                    repos[v].add(d)
    want = {}
    for d, *_ in rows:
        live = [bool((k == 4 or random_looking(v)) and len(owners[v]) <= 2 and len(repos[v]) <= 20) for _, k, _, v in found[d]]
        spans = sorted((s, k, e) for (s, k, e, _), x in zip(found[d], live, strict=True) if k < 3 or x)
        want[d] = (sum(live), sum(k < 3 for _, k, _, _ in found[d]) - sum(x for (_, k, _, _), x in zip(found[d], live, strict=True) if k < 3), ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans))
    got = {r["doc_id"]: (r["n_live"], r["n_shared"], r["spans"]) for r in secrets.secrets_by_document(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and got[60][0] and not got[1][0]


def test_ownership(spark):
    live, copied = "q7Zp2Lk9Xw4T", "c0piedEverywh3re"
    rows = [(1, f"password={live}", "a"), (2, f"password={live}", "a")] + [(i, f"password={copied}", f"o{i}") for i in range(3, 9)] + [(9, "ghp_" + "aB3" * 8 + " password=changeme123", "b")]
    df = spark.createDataFrame([(d, t, "en", s, 0) for d, t, s in rows], DOCS)
    got = {r["doc_id"]: (r["n_live"], r["n_shared"], r["spans"]) for r in secrets.secrets_by_document(df).collect()}
    assert got[1][:2] == (1, 0) and got[3][:2] == (0, 1)
    assert got[9] == (1, 1, "token:0:28,assign:29:49")
    assert {r["n_live"] for r in secrets.secrets_by_document(df, max_repos=1).where("doc_id < 3").collect()} == {0}
    spans = secrets.scan_secrets(df)
    assert {(r["n_owners"], r["n_repos"]) for r in spans.where(F.col("value") == sha(copied)).collect()} == {(6, 6)}
    assert not any(x in str(r) for r in spans.collect() for x in (live, copied))  # hashes alone go on


def test_secrets_awkward(spark):
    df = awkward(spark)
    got = secrets.secrets_by_document(df)
    assert got.count() == df.count()
    assert [r["spans"] for r in got.where("n_assign > 0").collect()] == ["assign:0:19"]
    assert secrets.secrets_by_document(df.limit(0)).count() == 0


# packing


def check_packing(df, rows, path, window):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in df.collect())
    seqs = defaultdict(list)
    docs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    pad = 0
    for pieces in seqs.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= window
        pad += 0 if at & (at - 1) == 0 else window - at
    assert sum(r["length"] for r in rows) == sum(len(x[2]) // 4 for x in want)
    for d, ids in ((d, ids) for no, d, ids in want if not no):
        own = [r for r in docs[d] if r["doc_tokens"] == len(ids) // 4]
        starts = sorted({(r["start"], tuple(r["ids"])) for r in own})
        if sum(1 for x in want if x[1] == d and not x[0]) == 1:
            assert np.array([i for _, p in starts for i in p], "<u4").tobytes() == ids
    return pad


def test_packing(spark, sf):
    path = queries.tokenizer_path()
    for df in (spark.read.parquet(f"{sf}/documents.parquet").repartition(3), awkward(spark)):
        rows = packing.pack(df, path, with_ids=True).collect()
        assert check_packing(df, rows, path, 2048) == 0
    assert packing.pack(df.limit(0), path).count() == 0


def test_level_choice_by_brute_force():
    random.seed(4)
    p = packing._Packer(12)
    for i in range(300):
        n = random.randint(1, 11)

        def cost(level):
            c = p.count.copy()  # noqa: B023
            if level:
                c[level] -= 1
            if level + n < 12:  # noqa: B023
                c[level + n] += 1  # noqa: B023
            return int((c**2).sum())

        open_levels = [0] + [h for h in range(1, 12 - n + 1) if p.count[h]]
        got = p.level_for(n)
        assert got in open_levels and cost(got) == min(map(cost, open_levels))
        p.put(i, n, 0, np.zeros(n, np.uint32))
        assert all(len(p.open.get(h, [])) == p.count[h] for h in range(13))


def test_word_cache():
    cache = packing.WordCache(queries.tokenizer_path())
    odd = ["á b́", "x\x1cy\x85z q", "  ", "", "İstanbul ΣΑΣ don't DON'T it's, 'S. K. ſ.", "ﬁ\r\nÅ", "<|endoftext|> a <|ENDOFTEXT|>.", "日本 ½²३ É, é.. a., a,. A. 1. .,"]
    odd += ["Merhaba İ, İ.", "İ. ŉ, ǰ. ẖ.", "ΐ. e\u0307. é, e\u0301,"]
    for x in odd + [" ".join(odd)]:
        assert cache.encode([x])[0].tolist() == cache.tokenizer.encode(x, add_special_tokens=False).ids


def test_ids_over_all_of_unicode():
    """Whole texts: every code point before a full stop and a comma, and random strings over all of Unicode."""
    cache = packing.WordCache(queries.tokenizer_path())
    assert cache.by_chunk
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(11)
    letters = [c for c in points if chr(c).isalpha() and not (0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x17000)]
    texts = [" ".join(f"{chr(c)}. a{chr(c)}, {chr(c)}b." for c in letters[i : i + 200]) for i in range(0, len(letters), 200)]
    some = [ord(c) for c in " \n\t.,'<|>aAİß\u0301\u0307"]
    texts += ["".join(chr(rng.choice(points if rng.random() < 0.4 else letters if rng.random() < 0.5 else some)) for _ in range(rng.randrange(1, 60))) for _ in range(6000)]
    want = [e.ids for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in cache.encode(texts)] == want


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers

    cache = packing.WordCache(public_tokenizers.path("byte_bpe_50k.json"))
    assert not cache.by_chunk
    texts = ["Two  words.\n\n  x", "", "İ. <|endoftext|>"]
    assert [x.tolist() for x in cache.encode(texts)] == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# SimHash


def test_fingerprint_by_definition():
    import xxhash

    for text in ("", " \n", "one", "One two", "a b c", "a b c d a b c", "é É Ä\x0b x y"):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert simhash.fingerprint(text.encode()) == want


def near_model(pairs):
    """doc_id -> least doc_id reachable over fingerprints within 3 bits."""
    ids, group = [d for d, _ in pairs], {d: d for d, _ in pairs}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for (a, x), (b, y) in itertools.combinations(pairs, 2):
        if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
            p, q = sorted((root(a), root(b)))
            group[q] = p
    return {d: root(d) for d in ids}


@pytest.mark.parametrize("large", [2048, 16])
def test_links_by_brute_force(monkeypatch, large):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 60, dtype=np.int64)]
    for _ in range(400):
        x = fps[rng.integers(0, len(fps))] if rng.random() < 0.5 else fps[0]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        fps.append(x - 2**64 if x >= 2**63 else x)
    fp = np.unique(np.array(fps, np.int64))
    key, i, home = simhash.anchors(fp.view(np.uint64))
    o = np.lexsort((fp[i], key))
    a, b = simhash.sorted_links(key[o], fp[i][o], home[o])
    x, y = np.nonzero(np.bitwise_count(fp.view(np.uint64)[:, None] ^ fp.view(np.uint64)[None]) <= 3)
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(*(z.tolist() for z in simhash.stars(fp[x], fp[y])), strict=True))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


def test_near_duplicates(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.near_duplicates(df).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == near_model([(r["doc_id"], r["fp"]) for r in got])


def test_near_awkward(spark):
    df = awkward(spark)
    got = simhash.near_duplicates(df)
    groups = {(r["doc_id"], r["component_id"]) for r in got.collect()}
    assert got.count() == df.count()
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (7, 4), (None, 5), (5, 5)} <= groups
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r["__id"] for r in kept.collect()} == {"clash"}
    assert kept.where("doc_id in (1, 4, 8)").count() == 3 and kept.where("doc_id in (2, 3, 7)").count() == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_texts_are_shuffled_once_for_suffix_dedup(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = suffix_dedup.dedup_substrings(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(doc_id#" in line and "_groupingexpression" not in line]
    assert len([line for line in dealt if "ReusedExchange" not in line]) == 1, plan


# shingles


def shingle_sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pipeline_near_copies_by_brute_force(spark, sf):
    """The pipeline's stage: planted near copies, chains and the table's own rows, by every pair's five-word Jaccard of 0.8."""
    import corpus_pipeline

    rng = random.Random(3)
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(8):  # a chain: each copy changes the one before it
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(max(1, len(words) // 80)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    texts += ["a a a a a", "a a a a a a a", "one two", "One  two", None, " \n"]
    sets = [shingle_sets(t) for t in texts]
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
            p, q = sorted((group[i], group[j]))
            group = [p if g == q else g for g in group]
    kept = corpus_pipeline.drop_near_copies(spark, docs_of(spark, texts, 0), sf)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(group))


def test_pipeline_links_by_bits_too(spark, sf):
    """Few unlike shingles beside one that repeats: within three bits, but far below a Jaccard similarity of 0.8."""
    import corpus_pipeline

    body = "a b c " * 200
    texts = [body + "p q r s t", body + "u v w x y", "quite another text of its own"]
    assert (simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(texts[1].encode())).bit_count() <= 3
    assert shingles.keep_one(docs_of(spark, texts, 0)).count() == 3
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs_of(spark, texts, 0), sf).collect()) == [0, 2]


def test_pairs_across_components(monkeypatch, spark, sf):
    """With no turns at all, the comparison across components finds the same."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows_of(shingles.keep_one(docs).select("doc_id"))
    monkeypatch.setattr(shingles, "TURNS", 0)
    assert rows_of(shingles.keep_one(docs).select("doc_id")) == got


def test_shingles_awkward(spark):
    df = awkward(spark)
    groups = {(r["doc_id"], r["component_id"]) for r in shingles.near_duplicates(df).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (7, 4), (None, 5), (5, 5)} <= groups
    kept = shingles.keep_one(df)
    assert kept.columns == df.columns
    assert kept.where("doc_id in (1, 4, 8)").count() == 3 and kept.where("doc_id in (2, 3, 7)").count() == 0
    assert shingles.keep_one(df.limit(0)).count() == 0


def test_rows_that_repeat_id_and_text_keep_a_defined_one(spark):
    df = spark.createDataFrame([(1, "the same text", x) for x in ("c", "a", "b")] + [(2, "other words altogether", None)], "doc_id long, text string, extra string")
    for keep in (simhash.keep_one, shingles.keep_one):
        for parts in (1, 3):
            assert sorted((r["doc_id"], r["extra"]) for r in keep(df.repartition(parts)).collect()) == [(1, "a"), (2, None)]


# chat


def cheapest(roles):
    """Least cost by trying every way, three empty messages in a row at most."""
    import functools

    after = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    @functools.cache
    def go(k, last, added):
        best = 0 if k == len(roles) and last == "assistant" else 10**9
        if k < len(roles):
            change = lambda r: 0 if r == roles[k] else 1 if roles[k] not in chat.ROLES else 2
            best = min([best] + [change(r) + go(k + 1, r, 0) for r in after[last]] + ([1 + change(last) + go(k + 1, last, 0)] if last else []))
        return min([best] + ([3 + go(k, r, added + 1) for r in after[last] if r != "system"] if added < 3 else []))

    return go(0, None, 0)


def test_role_repair(spark):
    random.seed(1)
    convs = {c: [random.choice([*chat.ROLES, "tool", None]) for _ in range(random.randint(1, 9))] for c in range(150)}
    df = spark.createDataFrame([(c, i, r, f"t{i}" if i % 3 else None) for c, rs in convs.items() for i, r in enumerate(rs)], "conv_id long, turn long, role string, text string")
    rows = defaultdict(list)
    for r in chat.repair_chats(df, segment=3).orderBy("conv_id", "turn", "place").collect():
        rows[r["conv_id"]].append(r)
    for c, roles in convs.items():
        own = rows[c]
        assert sum(r["cost"] for r in own) == own[0]["total_cost"] == cheapest(tuple(roles))
        text = "".join(r["fragment"] for r in own)
        messages = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", text, re.S)
        assert "".join(f"<|{a}|>\n{b}<|end|>\n" for a, b in messages) == text
        turns = [m[0] for m in messages if m[0] != "system"]
        assert [m[0] for m in messages[1:]].count("system") == 0 and turns == ["user", "assistant"] * (len(turns) // 2)
        assert re.findall(r"t\d+", text) == [f"t{i}" for i in range(len(roles)) if i % 3]


@pytest.mark.parametrize("segment", [1, 4, 256])
def test_many_turns_of_one_number(spark, segment):
    """One conversation whose turns share few numbers, or none, is cut into segments all the same, and its places have no gaps."""
    rng = random.Random(segment)
    rows = [(None, rng.choice([None, 3, 4]), rng.choice(["user", "assistant", None]), f"t{i:03d}") for i in range(120)] + [(1, 7, "user", f"u{i:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = chat.repair_chats(df, segment).collect()
    by_turn = defaultdict(list)
    for r in got:
        by_turn[r["conv_id"], r["turn"]].append(r["place"])
    assert len(got) == 150 and all(sorted(x) == list(range(len(x))) for x in by_turn.values())
    want = sorted(rows[:120], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3]))
    own = sorted((r for r in got if r["conv_id"] is None), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["place"]))
    assert re.findall(r"t\d+", "".join(r["fragment"] for r in own)) == [r[3] for r in want]
    assert {r["total_cost"] for r in own} == {sum(r["cost"] for r in own)} == {cheapest(tuple(r[2] for r in want))}


def test_chat_awkward(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 5, "user", "x"), (1, 5, "user", "x"), (2, -3, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seg", F.lit("clash")).withColumn("total", F.lit(1))
    got = chat.repair_chats(df)
    assert got.count() == 5 and sorted(r["place"] for r in got.where("turn = 5").collect()) == [0, 1]
    assert chat.repair_chats(df.limit(0)).count() == 0


# toxicity


def test_label_model_finds_good_and_copied_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    good = [np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(3)]
    noise = [rng.random(4000) < 0.3]
    votes = np.stack([*good, noise[0], noise[0], noise[0]], 1).astype(int)
    votes[rng.random(votes.shape) < 0.2] = toxicity.SILENT
    p, rate, weight = toxicity.label_model(votes, start=(votes[:, :3] == 1).mean(1))
    assert ((p > 0.5) == y).mean() > 0.93
    assert (rate[1, :3] > 0.8).all() and (rate[0, :3] < 0.2).all() and abs(rate[1, 3] - rate[0, 3]) < 0.1
    assert weight[3] < 0.6 < weight[0]


def em_by_loops(votes, rounds):
    """The label model written out over single votes."""
    n, m = len(votes), len(votes[0])
    p = [sum(v == 1 for v in row) / max(1, sum(v >= 0 for v in row)) for row in votes]
    clip = lambda x, lo, hi: min(max(x, lo), hi)
    p = [clip(x, 0.02, 0.98) for x in p]
    p = [clip(x / max(p), 0.02, 0.98) for x in p]
    for _ in range(rounds):
        mass = [[1 - x for x in p], p]
        rate = [[clip((sum(w[i] for i in range(n) if votes[i][j] == 1) + 0.5) / (sum(w[i] for i in range(n) if votes[i][j] >= 0) + 1), 1e-3, 1 - 1e-3) for j in range(m)] for w in mass]
        left = [[0.0 if votes[i][j] < 0 else votes[i][j] - (1 - p[i]) * rate[0][j] - p[i] * rate[1][j] for j in range(m)] for i in range(n)]
        norm = [math.sqrt(sum(left[i][j] ** 2 for i in range(n))) for j in range(m)]
        corr = lambda j, k: max(0, sum(left[i][j] * left[i][k] for i in range(n)) / (norm[j] * norm[k]))  # noqa: B023, E731
        weight = [1 / (1 + sum(corr(j, k) for k in range(m) if k != j)) for j in range(m)]
        prior = sum(p) / n
        new = []
        for row in votes:
            z = math.log(prior / (1 - prior))
            for j, v in enumerate(row):
                if v >= 0:
                    z += weight[j] * math.log(rate[1][j] / rate[0][j] if v else (1 - rate[1][j]) / (1 - rate[0][j]))
            new.append(1 / (1 + math.exp(-z)))
        p = new
    return p


@pytest.mark.parametrize("rounds", [1, 2, 6])
def test_posteriors_by_brute_force(rounds):
    rng = np.random.default_rng(rounds)
    y = rng.random(60) < 0.3
    votes = np.stack([np.where(rng.random(60) < q, y, ~y) for q in (0.9, 0.8, 0.7, 0.85)], 1).astype(int)
    votes[rng.random(votes.shape) < 0.3] = toxicity.SILENT
    assert np.allclose(toxicity.label_model(votes, rounds)[0], em_by_loops(votes.tolist(), rounds), atol=1e-4)


def test_classifier_by_brute_force():
    """Few terms, soft targets: the accelerated steps reach the optimum of plain small steps."""
    rng = np.random.default_rng(1)
    x = rng.random((40, 3)) < 0.4
    target = rng.random(40)
    rows, cols = np.nonzero(x)
    bias, w = toxicity.logistic(rows, cols, 3, target)
    b, v = 0.0, np.zeros(3)
    for _ in range(20_000):
        g = 1 / (1 + np.exp(-(b + x @ v))) - target
        b, v = b - 0.05 * g.sum(), v - 0.05 * (x.T @ g + 0.05 * v)
    assert np.allclose([bias, *w], [b, *v], atol=1e-3)


def test_votes():
    terms, rows, cols = ["idiot", "vile", "mined", "mine*"], np.array([0, 0, 1]), np.array([0, 2, 3])
    votes = toxicity.cast_votes(rows, cols, terms, np.array([30, 20, 5]), np.array([2, 1, 0]), np.array([8.0, 3.0, 0.0]), 5)
    assert votes[0].tolist() == [1, 1, 0, 0, 0, 1, -1, 1, -1, 1]  # the fixed list, mined words, beginnings of 4, 5 and 6; five patterns
    assert votes[1].tolist() == [0, 0, 1, 0, 0, -1, 0, 0, 0, 1]
    assert set(votes[2].tolist()) == {-1}


def test_copies_count_once_only_with_equal_labels(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, text if i < 40 else f"{text} other ending {i}") for i in range(42)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], DOCS)
    labels = spark.createDataFrame([(d, int(d % 2)) for d, _ in rows], "doc_id long, toxic int")
    assert toxicity._sample(docs, labels, 100, True).groupBy("label").count().count() == 2
    assert toxicity._sample(docs, labels, 100, True).count() < toxicity._sample(docs, labels, 100, False).count()


@pytest.mark.parametrize("size", ["sf0.01"])
def test_toxicity_held_out(spark, size):
    sf = f"/root/testdata/{size}"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hits = [(r["predicted"], r["toxic"]) for r in got]
    caught = sum(p and t for p, t in hits)
    assert caught >= 0.7 * sum(t for _, t in hits)
    assert sum(p and not t for p, t in hits) <= 0.03 * len(hits)


def test_toxicity_awkward(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(4, 0), (5, 1), (None, 1), (6, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(df, labels)
    assert got.count() == df.count() and all(0 <= r["score"] <= 1 for r in got.collect())
    assert toxicity.toxicity(df, labels.limit(0)).agg(F.sum("predicted")).first()[0] == 0
    kept = toxicity.reject_toxic(df, labels.limit(0))
    assert kept.columns == df.columns and kept.count() == df.count()
    assert {r["score"] for r in kept.collect()} == {"clash"}
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def test_labels_of_held_out_rows_do_not_count(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.is_held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert rows_of(toxicity.toxicity(docs, labels)) == rows_of(toxicity.toxicity(docs, other))


# top-k


@pytest.mark.parametrize(("query_rows", "candidate_rows", "fan_in"), [(2048, 8192, 16), (3, 7, 2)])
def test_top_k(spark, query_rows, candidate_rows, fan_in):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 4) / 8]) for i in range(120)]
    rows += [(None, [1.0] * 4), (500, None), (501, [1.0, None, 0.0, 0.0]), (502, [float("nan")] * 4), (503, [float("inf")] * 4), (504, []), (505, [1.0, 2.0]), (506, [2.0, 2.0]), (7, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = top_k.exact_top_k(df.where("vec_id % 5 = 0"), df, k=5, query_rows=query_rows, candidate_rows=candidate_rows, fan_in=fan_in)
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in good if c != q and len(w) == len(v))[:5]
            want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert top_k.exact_top_k(df.limit(0), df).count() == 0


def test_products_beyond_floating_point():
    q, c = np.array([[2.0**30, 1]]), np.array([[2.0**30, 1], [2.0**30, 0]])
    assert top_k._product(q, c).tolist() == [[2**60 + 1, 2**60]]
    assert top_k._product(np.array([[2.0**70, 1, -3.0]]), np.array([[2.0**70, 1, 2.0]])).tolist() == [[2**140 - 5]]
    assert top_k.quantized(np.array([[1e307, -0.001]]), 256).tolist() == [[int(1e307) * 256, -1]]


def test_all_finite_components_take_part(spark):
    """Large components, with scores beyond 64 bits among those that are not in the result."""
    rows = [(0, [1e15, 0.0]), (1, [3e7, 4e7]), (2, [-1e30, 1.0]), (3, [0.0, 1e300]), (4, [1.0, 1.0]), (5, [-5.0, 2.0]), (6, [2e2, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fits = lambda s: -(2**63) <= s < 2**63
    whole = {i: [math.floor(x) * 256 if abs(x) > 2**60 else math.floor(256 * x) for x in v] for i, v in rows}
    for q, k in ((5, 2), (4, 1), (0, 2), (6, 3)):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:k]
        search = top_k.exact_top_k(df.where(F.col("vec_id") == q), df, k=k, candidate_rows=2)
        if all(fits(-s) for s, _ in best):
            assert [tuple(r) for r in search.orderBy("rank").collect()] == [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
        else:
            with pytest.raises(Exception, match="does not fit 64 bits"):
                search.collect()


def test_copies_of_one_vector_are_dealt_out(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0])] * 500 + [(2, [1.0, 0.5]), (3, [2.0, 2.0])], "vec_id long, embedding array<float>")
    got = top_k.exact_top_k(df.where("vec_id = 2"), df, k=4, candidate_rows=50).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, 512 * 256 + 512 * 128)] + [(1, 256 * 256 + 256 * 128)] * 3
