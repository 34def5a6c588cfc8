"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints within 3 bits agree up to 1 bit in one of their 32-bit
halves. Over each half, the codewords of the perfect Hamming code of length 31,
with the 32nd bit free, are the anchors: the covering radius is 1. A
fingerprint's home is its nearest anchor, and it is replicated to every anchor
within covering radius plus threshold, 1 + 1 = 2: at most 17 a half. If two
fingerprints link, each is found at the other's home. So per anchor its home
fingerprints are compared with all that came there, and a task sends on the
spanning stars of the links it saw, never all pairs of a group.

Only distinct fingerprints are dealt out; copies are joined back at the end.
A large anchor group is compared in classes that share one byte of the other
half, as three bits cannot spoil all four. Components grow by large-star and
small-star rounds over checkpointed edges.

Defined results: a null, empty or blank text has fingerprint zero, which links
like any other. Fewer words than a shingle: their whole sequence is the one
shingle. Rows that repeat a doc_id keep a row each; a null doc_id takes part but
is never a component's id (null if it has no other). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut, row_key

SEED = 42
THRESHOLD = 3
#: Groups beyond this many members are compared by byte classes.
LARGE = 2048


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash over shingles of words: XXH64 of each, repeats included, majority by bit."""
    import xxhash

    w = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    digest = xxhash.xxh64_intdigest
    a, b = starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(a), 65536):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a[at : at + 65536], b[at : at + 65536], strict=True)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(a)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, row_key, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, np.uint64)
            texts = batch.column(2)
            for at in range(0, batch.num_rows, 512):
                for i, t in enumerate(texts.slice(at, 512).cast(pa.binary()).to_pylist()):
                    out[at + i] = fingerprint(t or b"", words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.view(np.int64))], names=["doc_id", "row_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, fp long")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the flips that lead to each anchor within 2, and how many; the first is the home's."""
    flips, sizes = np.zeros((32, 17), np.uint64), np.zeros(32, np.int64)
    bit = lambda i: 1 << (i - 1)
    top = 1 << 31
    for s in range(32):
        near = bit(s) if s else 0
        own = [near] + ([bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s and i != s] if s else []) + [near | top]
        flips[s, : len(own)] = own
        sizes[s] = len(own)
    return flips, sizes


def _syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the places (1 to 31) of the set bits."""
    out = np.zeros(len(half), np.int64)
    for p in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> p & 1)
        out |= (np.bitwise_count(half & np.uint64(mask)).astype(np.int64) & 1) << p
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, index of the fingerprint, home): one entry for each anchor of each half."""
    flips, sizes = _masks()
    keys, rows, homes = [], [], []
    for half in (0, 1):
        v = (fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        s = _syndrome(v)
        n = sizes[s]
        i = np.repeat(np.arange(len(fps)), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        keys.append(((v[i] ^ flips[s[i], j]) | np.uint64(half << 32)).astype(np.int64))
        rows.append(i)
        homes.append(j == 0)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 20_000):
            part = fps[at : at + 20_000]
            key, i, home = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[i]), pa.array(home)], names=["anchor", "fp", "home"])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the components that the links a[i]-b[i] make; the root is the least, roots themselves left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= THRESHOLD


def _block_links(rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The stars of each block of at most 1024 x 1024 comparisons."""
    for i in range(0, len(rows), 1024):
        for j in range(0, len(cols), 1024):
            r, c = rows[i : i + 1024], cols[j : j + 1024]
            x, y = np.nonzero(np.bitwise_count(r.view(np.uint64)[:, None] ^ c.view(np.uint64)[None, :]) <= THRESHOLD)
            keep = r[x] != c[y]
            if keep.any():
                yield stars(r[x][keep], c[y][keep])


def group_links(fp: np.ndarray, home: np.ndarray, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links at one anchor over ``half``: its home fingerprints against all that came."""
    if len(fp) <= LARGE:
        yield from _block_links(fp[home], fp)
        return
    for byte in range(4):
        own = (fp.view(np.uint64) >> np.uint64((0 if half else 32) + 8 * byte)) & np.uint64(255)
        order = np.argsort(own, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            yield from _block_links(fp[members][home[members]], fp[members])


def sorted_links(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, small: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links among rows that are sorted by anchor; each anchor's rows are complete."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(anchor)))
    tiny = np.repeat(sizes <= small, sizes)
    for d in range(1, int(min(small, sizes.max(initial=0)))):
        i = np.flatnonzero(tiny[:-d] & (anchor[:-d] == anchor[d:]) & (home[:-d] | home[d:]))
        i = i[_close(fp[i], fp[i + d])]
        if len(i):
            found.append((fp[i], fp[i + d]))
    for at, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        found += group_links(fp[at : at + n], home[at : at + n], int(anchor[at] >> 32))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return stars(a, b)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rest: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        a, b = sorted_links(*cols)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for batch in batches:
        cols = [np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest)]
        last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        rest = [c[last:] for c in cols]
        yield links([c[:last] for c in cols])
    yield links(rest)


def links(distinct: DataFrame) -> DataFrame:
    """u, v: links among distinct fingerprints (column fp) that span the same components as all links within 3 bits."""
    dealt = distinct.select("fp").mapInArrow(_replicate, "anchor long, fp long, home boolean")
    together = dealt.repartition("anchor").sortWithinPartitions("anchor", "fp")
    return together.mapInArrow(_compare, "u long, v long").dropDuplicates()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """node, root: the least node reachable over edges (u, v); nodes that are roots have no row."""
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").dropDuplicates())
    mark = lambda x: x.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).dropDuplicates()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).dropDuplicates()
        e = cut(small)
        after = mark(e)
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, row_key, fp, component_id (the smallest doc_id that is reachable over links), root (the least fp)."""
    own = cut(fingerprints(docs, words))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.select("fp", "root").join(of_root, "root").select("fp", "component_id", "root")
    return own.join(of_fp, "fp").select("doc_id", "row_key", "fp", "component_id", "root")


def keep_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs that ``first`` (doc_id, row_key) names; of rows that repeat both, the least by its other columns as JSON."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # a null id gets a name of its own, so plain keys serve both the join and what follows it
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    own = docs.select(row, name(F.col("doc_id")).alias("id"), row_key().alias("key"))
    kept = own.join(first.select(name(F.col("doc_id")).alias("id"), F.col("row_key").alias("key")).dropDuplicates(), ["id", "key"], "left_semi")
    others = F.to_json(F.struct(*[F.col(f"row.`{c}`") for c in docs.columns if c != "text"]))
    rank = F.row_number().over(Window.partitionBy("id", "key").orderBy(others, F.col("row.text")))
    one = kept.withColumn("rank", rank).where("rank = 1")
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """One document of each component stays: its smallest doc_id. Of rows that repeat that doc_id, one stays."""
    near = near_duplicates(docs, words)
    first = near.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("x"))
    return keep_rows(docs, first.select("x.doc_id", "x.row_key"))
