"""Near-dedup by the likeness of word shingles, exact on what it links.

Two texts link if the Jaccard similarity of their sets of five-word shingles is
0.8 or more. Candidates share one of 20 bands of four min-hashes: a pair at
exactly 0.8 shares none with a chance of 3 in 100,000, and likelier pairs less.
Every candidate that could join two components is settled by its texts:

1. for a few turns, each text that shares a band with another component is compared
   with one text: the least head of its bands, a band's head being its least text in
   the turn's order (a map-side combined minimum, joined back). So a turn compares a
   linear number of pairs, and large groups of near copies grow together;
2. in groups that still hold several components, texts with a likely partner in
   another one are compared across components by their whole sets of shingles. A
   group is one task's; it sends on stars that span its links, never all pairs.

The texts that share a band are written out once, and pairs are joined with these.
Before texts are fetched, a pair has to agree in 50 of 80 bytes of its min-hashes
(64 on average at a similarity of 0.8, deviation 3.6: a chance of 7 in 100,000). Components are those of
``simhash``. Results are exact up to hash collisions and these chances.

Defined results: words are as in ``simhash``. Texts of equal words are one text;
null, empty and blank ones too. Fewer words than a shingle: their whole sequence
is the one shingle. Rows that repeat a doc_id keep a row each in near_duplicates;
a null doc_id is never a component's id unless it has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut, row_key
from tidepool.llm.simhash import SEED, components, keep_rows, stars

WORDS = 5
BANDS, ROWS = 20, 4
#: Of BANDS * ROWS bytes, so many agree before a pair's texts are compared.
AGREE = 50
#: Turns in which texts are compared with a head.
TURNS = 2

_RNG = np.random.default_rng(SEED)
_MUL = _RNG.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of the text's shingles, sorted."""
    import xxhash

    w = text.lower().split()  # bytes: A-Z and ASCII white space alone
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(w))
    digest = xxhash.xxh64_intdigest
    a, b = starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a)))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 5 * both >= 4 * (len(a) + len(b) - both)


def signature(own: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of the hash functions."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, (own[None, at : at + 1024] * _MUL + _ADD).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    m = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key * _FOLD) ^ m[:, r]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch(least: np.ndarray) -> bytes:
    return (least >> np.uint64(16)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, tid (a hash of the text's words), keys, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                tids, keys, sketches = [], [], []
                for t in part.column(2).cast(pa.binary()).to_pylist():
                    own = shingles(t or b"")
                    least = signature(own)
                    tids.append(xxhash.xxh64_intdigest(b" ".join((t or b"").lower().split()), SEED))
                    keys.append(band_keys(least) if len(own) else [])
                    sketches.append(sketch(least))
                tid = pa.array(np.array(tids, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), tid, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "row_key", "tid", "keys", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(run, "doc_id long, row_key long, tid long, keys array<long>, sketch binary")


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = (_bytes(batch.column(2)) == _bytes(batch.column(3))).sum(1) >= AGREE
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["u", "v"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for at in range(0, batch.num_rows, 256):
            texts = (batch.column(i).slice(at, 256).cast(pa.binary()).to_pylist() for i in (2, 3))
            for i, (a, b) in enumerate(zip(*texts, strict=True)):
                keep[at + i] = alike(shingles(a or b""), shingles(b or b""))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["u", "v"])


def _by_key(batches: Iterator[pa.RecordBatch], columns: Callable, settle: Callable) -> Iterator[pa.RecordBatch]:
    """Calls ``settle`` with the columns of whole keys; rows are sorted by key."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        new = columns(batch)
        cols = new if rest is None else [np.concatenate([r, n]) for r, n in zip(rest, new, strict=True)]
        last = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        rest = [c[last:] for c in cols]
        if last:
            yield settle(*[c[:last] for c in cols])
    if rest is not None and len(rest[0]):
        yield settle(*rest)


def _edges(*cols: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], np.any([x[1:] != x[:-1] for x in cols], axis=0), [True]]))


def _open(key: np.ndarray, root: np.ndarray, tid: np.ndarray, sk: np.ndarray) -> pa.RecordBatch:
    """The rows that have a likely partner in another component of their key; rows are sorted by key and root."""
    ends, parts, flags = _edges(key), _edges(key, root), np.zeros(len(key), bool)
    for lo, hi, end in zip(parts[:-1], parts[1:], ends[np.searchsorted(ends, parts[:-1], "right")], strict=True):
        for i in range(lo, hi, 128):
            for j in range(hi, end, 1024):
                r, c = slice(i, min(i + 128, hi)), slice(j, min(j + 1024, end))
                likely = (sk[r][:, None] == sk[c][None]).sum(2, dtype=np.uint8) >= AGREE
                flags[r] |= likely.any(1)
                flags[c] |= likely.any(0)
    return pa.RecordBatch.from_arrays([pa.array(x[flags]) for x in (key, root, tid)], names=["key", "root", "tid"])


def _lists(column: pa.Array) -> np.ndarray:
    """An object array of the arrays."""
    out = np.empty(len(column), object)
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        out[i] = values[at[i] : at[i + 1]]
    return out


def _settle(key: np.ndarray, root: np.ndarray, tid: np.ndarray, sets: np.ndarray) -> pa.RecordBatch:
    """Links across components within each key, by whole sets; stars that span them."""
    ends, found = _edges(key), []
    for lo, hi in zip(ends[:-1], ends[1:], strict=True):
        own, size = root[lo:hi], np.array([len(x) for x in sets[lo:hi]])
        roots, n = np.unique(own, return_counts=True)
        if len(roots) < 2:
            continue
        words, at = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
        starts = np.cumsum(size) - size
        mark = np.zeros(len(words), np.int64)
        for i in np.flatnonzero(own != roots[n.argmax()]):
            mine = at[starts[i] : starts[i] + size[i]]
            mark[mine] = 1
            both = np.add.reduceat(mark[at], starts)
            mark[mine] = 0
            y = np.flatnonzero((5 * both >= 4 * (size + size[i] - both)) & (own != own[i]))
            y = y[np.unique(own[y], return_index=True)[1]]
            found.append((np.full(len(y), tid[lo + i]), tid[lo:hi][y]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    u, v = stars(a, b) if len(a) else (a, b)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_key(batches, lambda b: [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)), _bytes(b.column(3))], _open)


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _by_key(batches, lambda b: [*(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)), _lists(b.column(3))], _settle)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [shingles(t or b"").view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["tid", "shingles"])


def _id(col: str = "doc_id"):
    # a null id gets a name of its own, so plain keys serve the joins
    return F.coalesce(F.col(col).cast("string"), F.lit("none"))


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with the labels that links (a, b) join made one, as far as two steps go; labels only save comparisons."""
    down = links.select(F.greatest("a", "b").alias("label"), F.least("a", "b").alias("to")).groupBy("label").agg(F.min("to").alias("to"))
    again = down.select(F.col("label").alias("to"), F.col("to").alias("further"))
    steps = down.join(again, "to", "left").select("label", F.coalesce("further", "to").alias("to"))
    return rows.join(steps, "label", "left").select("key", "tid", F.coalesce("to", "label").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, tid, component_id (the smallest doc_id that is reachable over links), root (the least tid)."""
    own = cut(signatures(docs))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("least")
    distinct = cut(own.groupBy("tid").agg(least, F.first("keys").alias("keys"), F.first("sketch").alias("sketch")))
    dealt = distinct.select("tid", F.explode("keys").alias("key"))
    rows = cut(dealt.join(dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key", "left_semi").select("key", "tid", F.col("tid").alias("label")))
    where = distinct.join(rows.select("tid").dropDuplicates(), "tid", "left_semi").select("tid", "sketch", _id("least.doc_id").alias("id"), F.col("least.row_key").alias("row_key"))
    texts = docs.select(_id().alias("id"), row_key().alias("row_key"), "text").join(where, ["id", "row_key"])
    held = cut(texts.groupBy("tid").agg(F.first("sketch").alias("sketch"), F.first("text").alias("text")))

    def both(pairs: DataFrame, column: str) -> DataFrame:
        of = lambda c: held.select(F.col("tid").alias(c), F.col(column).alias(f"{column}_{c}"))
        return pairs.select("u", "v").join(of("u"), "u").join(of("v"), "v").select("u", "v", f"{column}_u", f"{column}_v")

    links, tried = None, None
    for turn in range(TURNS):
        order = F.xxhash64("tid", F.lit(turn))
        heads = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min(F.struct(order.alias("order"), F.col("tid").alias("head"), F.col("label").alias("head_label"))).alias("x"))
        mixed = cut(rows.join(heads.where("a <> b").select("key", "x.*"), "key"))
        rows = mixed.select("key", "tid", "label")
        asked = mixed.where("label <> head_label").groupBy("tid", "label").agg(F.min(F.struct("order", "head", "head_label")).alias("x"))
        asked = asked.select(F.least("tid", "x.head").alias("u"), F.greatest("tid", "x.head").alias("v"), F.col("label").alias("a"), F.col("x.head_label").alias("b"))
        pairs = both(asked.dropDuplicates(["u", "v"]), "sketch").mapInArrow(_likely, "u long, v long")
        pairs = cut(pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti"))
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        found = cut(both(pairs, "text").mapInArrow(_alike, "u long, v long"))
        links = found if links is None else links.unionByName(found)
        rows = cut(_relabelled(rows, found.join(asked, ["u", "v"]).select("a", "b")))

    def rooted(rows: DataFrame, links: DataFrame | None) -> DataFrame:
        if links is None:
            return rows.withColumn("root", F.col("tid"))
        return rows.join(components(links), F.col("tid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "tid")).drop("node")

    placed = cut(rooted(rows.select("key", "tid"), links))
    several = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    together = lambda x, column: x.join(held.select("tid", column), "tid").select("key", "root", "tid", column).repartition("key").sortWithinPartitions("key", "root")
    left = cut(together(placed.join(several, "key", "left_semi"), "sketch").mapInArrow(_across, "key long, root long, tid long"))
    sets = held.join(left.select("tid").dropDuplicates(), "tid", "left_semi").select("tid", "text").mapInArrow(_sets, "tid long, shingles array<long>")
    sets = left.join(sets, "tid").select("key", "root", "tid", "shingles").repartition("key").sortWithinPartitions("key", "root")
    last = cut(sets.mapInArrow(_exact, "u long, v long").dropDuplicates())

    every = rooted(distinct.select("tid", "least"), last if links is None else links.unionByName(last))
    of_root = every.groupBy("root").agg(F.min("least").alias("least"))
    of_tid = every.select("tid", "root").join(of_root, "root").select("tid", F.col("least.doc_id").alias("component_id"), F.col("root"))
    return own.select("doc_id", "row_key", "tid").join(of_tid, "tid").select("doc_id", "row_key", "tid", "component_id", "root")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays: its smallest doc_id. Of rows that repeat that doc_id, one stays."""
    near = near_duplicates(docs)
    first = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("x"))
    return keep_rows(docs, first.select("x.doc_id", "x.row_key"))
