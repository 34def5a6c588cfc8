"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents within a task. Its words are numbered by
the benchmark's vocabulary; any other word ends a sequence, as no window can
hold it, and sequences shorter than the shortest window are left out of the
index for the same reason. Over what is left stand a suffix array, its
Burrows-Wheeler transform in a wavelet tree of bit ranks, and suffix positions
sampled every 32 words and at every sequence's start. All windows are searched
backward at once; occurrences are located by walking to a sampled position.
Occurrences become word spans, merged per document.

The windows are broadcast in blocks, as flat arrays: the benchmark's bytes are
counted first, and one of over ``block_mb`` is cut into blocks by a hash of its
items, each searched over all documents in a pass of its own, with an index of
its own words; spans of all passes are merged.

Defined results: a null text has no words, so an item of none has no window. A
window that stands in several items counts for each. Items without id have none.
Repeated items count once; rows that repeat doc_id and text are judged alike,
and all stay. Extra columns pass through ``decontaminate`` and are
ignored elsewhere. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import cut, row_key, unused

WINDOW = 13
SAMPLE = 32
#: Words of a shard's index before it is searched and a new one begun.
SHARD_WORDS = 1_500_000
#: Word bytes: 0-9, a-z and all beyond ASCII; A-Z in lower case; the rest becomes blank.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Windows:
    """The distinct windows of items, in flat arrays: a vocabulary, the items' word numbers, each window's place and length in them, and its items.

    The vocabulary is a dict, so a block costs its distinct words there and about 40 bytes for each word otherwise.
    """

    def __init__(self, items: Iterable[tuple[int | None, bytes]], size: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        own, ids = [], []
        for item, text in items:
            w = words_of(text)
            if w:
                own.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w], np.int32))
                ids.append(item)
        self.size = size
        self.seq = np.concatenate(own) if own else np.empty(0, np.int32)
        n = np.array([len(x) for x in own], np.int64)
        many = np.maximum(1, n - size + 1)
        item = np.repeat(np.arange(len(own)), many)
        start = np.repeat(np.cumsum(n) - n, many) + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        length = np.repeat(np.minimum(n, size), many)
        # windows of equal words are one: named by two hashes of their words
        names = np.zeros((2, len(item)), np.uint64)
        for j in range(size):
            there = j < length
            word = np.where(there, self.seq[np.minimum(start + j, len(self.seq) - 1)], 0).astype(np.uint64) if len(item) else names[0]
            for h, base in zip(names, _BASES, strict=True):
                h *= base
                h += (word + np.uint64(1)) * _MIX
                h ^= h >> np.uint64(29)
        order = np.lexsort((item, names[1], names[0], length))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(names[:, order].astype(np.uint64), axis=1) != 0).any(0) | (np.diff(length[order]) != 0)
        first = np.flatnonzero(new)
        self.starts, self.lengths = start[order[first]].astype(np.int32), length[order[first]].astype(np.int8)
        # the items of window k, without those that have no id: ids[ends[k - 1] : ends[k]]
        name = np.array([-1 if x is None else 0 for x in ids], np.int64)
        real = np.array([x or 0 for x in ids], np.int64)
        of = item[order]
        fresh = new | np.append(True, np.diff(of) != 0)[: len(of)]
        fresh &= name[of] == 0 if len(of) else fresh
        self.ids = real[of[fresh]] if len(of) else real
        window = np.cumsum(new) - 1
        self.ends = np.cumsum(np.bincount(window[fresh], minlength=len(first))) if len(of) else np.empty(0, np.int64)
        self.least = int(self.lengths.min(initial=size))

    def word(self, windows: np.ndarray, back: int) -> np.ndarray:
        """The word that stands ``back`` places before the end of each window."""
        return self.seq[self.starts[windows] + self.lengths[windows] - back].astype(np.int64)

    def items_of(self, window: int) -> list[int]:
        return self.ids[self.ends[window - 1] if window else 0 : self.ends[window]].tolist()


_BASES, _MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)), np.uint64(0xD6E8FEB86659FD93)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix order of a sequence in which each 0 ends a suffix and ranks below all, zeros by place.

    Ranks double their depth each round; only suffixes that still tie are sorted again.
    """
    n = len(seq)
    zeros = np.flatnonzero(seq == 0)
    key = seq + len(zeros)
    key[zeros] = np.arange(len(zeros))
    sa = np.argsort(key, kind="stable")
    heads = np.concatenate([[True], key[sa][1:] != key[sa][:-1]]) if n else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = first
    depth = 1
    while n:
        tied = ~heads | ~np.append(heads[1:], True)  # in a group of two or more
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        s = sa[slots]
        beyond = rank[s + depth]  # a tied suffix has no 0 within its depth, so the next place exists
        group = first[slots]
        order = np.lexsort((beyond, group))
        s, beyond = s[order], beyond[order]
        sa[slots] = s
        heads[slots] = np.concatenate([[True], (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1])])
        first = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        rank[sa[slots]] = first[slots]
        depth *= 2
    return sa


class WaveletTree:
    """Ranks of symbols in a sequence, one level of stable partition by bit, highest bit first."""

    def __init__(self, seq: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each place
        self.zeros: list[int] = []
        for level in reversed(range(self.bits)):
            b = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(int(len(seq) - b.sum()))
            seq = np.concatenate([seq[b == 0], seq[b == 1]])
        self.begins = np.zeros(1 << self.bits, np.int64)
        values, first = np.unique(seq, return_index=True)
        self.begins[values] = first

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        at = place
        for k, level in enumerate(reversed(range(self.bits))):
            one = self.ones[k][at]
            at = np.where((symbol >> level) & 1, self.zeros[k] + one, at - one)
        return at - self.begins[symbol]

    def symbol_rank(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        at, symbol = place, np.zeros(len(place), np.int64)
        for k in range(self.bits):
            one = self.ones[k][at]
            b = self.ones[k][at + 1] - one
            symbol = 2 * symbol + b
            at = np.where(b, self.zeros[k] + one, at - one)
        return symbol, at - self.begins[symbol]


class FmIndex:
    """Backward search and location over a sequence with 0 after each of its parts."""

    def __init__(self, seq: np.ndarray, top: int):
        self.n = len(seq)
        sa = suffix_array(seq)
        self.tree = WaveletTree(seq[sa - 1], top)  # place -1 is the last 0
        counts = np.bincount(seq, minlength=top + 1)
        self.before = np.cumsum(counts) - counts
        starts = np.zeros(self.n, bool)
        starts[::SAMPLE] = True
        starts[1:] |= seq[:-1] == 0
        self.marked = starts[sa]
        self.samples = sa[self.marked]
        self.marks = np.concatenate([[0], np.cumsum(self.marked)])

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each window."""
        n = len(windows.lengths)
        lo, hi = np.zeros(n, np.int32), np.full(n, self.n, np.int32)
        live = np.arange(n)
        for step in range(1, windows.size + 1):
            live = live[(windows.lengths[live] >= step) & (lo[live] < hi[live])]
            for at in range(0, len(live), 1 << 18):  # in bounded runs
                part = live[at : at + (1 << 18)]
                c = windows.word(part, step)
                lo[part] = self.before[c] + self.tree.rank(c, lo[part])
                hi[part] = self.before[c] + self.tree.rank(c, hi[part])
        return lo.astype(np.int64), hi.astype(np.int64)

    def locate(self, slots: np.ndarray) -> np.ndarray:
        """Places of suffixes: steps back to a sampled one; a part's start is sampled, so no walk leaves its part."""
        out, walked = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        at, todo = slots.copy(), np.arange(len(slots))
        while len(todo):
            known = self.marked[at[todo]]
            out[todo[known]] = self.samples[self.marks[at[todo[known]]]] + walked[todo[known]]
            todo = todo[~known]
            symbol, rank = self.tree.symbol_rank(at[todo])
            at[todo] = self.before[symbol] + rank
            walked[todo] += 1
        return out


def search_shard(ids: list[np.ndarray], windows: Windows) -> list[tuple[list[tuple[int, int]], list[int]]]:
    """Per document: merged word spans [start, end) that windows cover, and the items found."""
    parts, docs, offsets = [], [], []
    for d, w in enumerate(ids):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], w > 0, [0]]).astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= windows.least:
                parts.append(np.append(w[a:b], 0))
                docs.append(d)
                offsets.append(a)
    spans: list[list[tuple[int, int]]] = [[] for _ in ids]
    items: list[set[int]] = [set() for _ in ids]
    if parts and len(windows.lengths):
        seq = np.concatenate(parts).astype(np.int64)
        index = FmIndex(seq, len(windows.vocab))
        begins = np.cumsum([0] + [len(p) for p in parts[:-1]])
        lo, hi = index.search(windows)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), np.maximum(n, 0))
        slots = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        for at in range(0, len(which), 1 << 20):  # located in bounded runs
            w, place = which[at : at + (1 << 20)], index.locate(slots[at : at + (1 << 20)])
            part = np.searchsorted(begins, place, side="right") - 1
            doc = np.asarray(docs)[part]
            start = place - begins[part] + np.asarray(offsets)[part]
            end = start + windows.lengths[w].astype(np.int64)
            for d, k in np.unique(np.stack([doc, w], 1), axis=0).tolist():
                items[d].update(windows.items_of(k))
            order = np.lexsort((start, doc))
            for d, s, e in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
                own = spans[d]
                if own and own[-1][0] <= s <= own[-1][1]:
                    own[-1] = (own[-1][0], max(e, own[-1][1]))
                else:
                    own.append((s, e))
    return [(merge(s), sorted(i)) for s, i in zip(spans, items, strict=True)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FOUND = "doc_id long, row_key long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _pass(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    rows = ((r["item_id"], (r["text"] or "").encode()) for r in items.select("item_id", "text").toLocalIterator())
    shared = docs.sparkSession.sparkContext.broadcast(Windows(rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        get, types = windows.vocab.get, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
        from itertools import repeat

        def emit(keys, ids) -> pa.RecordBatch:
            found = search_shard(ids, windows)
            cols = [[k[0] for k in keys], [k[1] for k in keys], [len(w) for w in ids], [[{"start": a, "end": b} for a, b in s] for s, _ in found], [i for _, i in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "row_key", "n_words", "spans", "items"])

        keys, ids, held = [], [], 0
        for batch in batches:
            doc, key, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for at in range(0, len(doc), 512):
                for i, t in enumerate(texts.slice(at, 512).cast(pa.binary()).to_pylist(), at):
                    w = words_of(t or b"")
                    keys.append((doc[i], key[i]))
                    ids.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
                    held += len(w)
                    if held >= SHARD_WORDS:
                        yield emit(keys, ids)
                        keys, ids, held = [], [], 0
        yield emit(keys, ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), "text").mapInArrow(run, FOUND)


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_mb: int = 16) -> DataFrame:
    """doc_id, row_key, n_words, spans (merged, in words), items: one row a document."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-int(total) // (block_mb << 20)))
    if blocks == 1:
        return _pass(docs, benchmark, size)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for b in range(blocks):
        one = cut(_pass(docs, benchmark.where(block == b), size)).where((F.size("spans") > 0) | F.lit(b == 0))
        found = one if found is None else found.unionByName(one)
    merged = F.aggregate(
        F.array_sort(F.flatten(F.collect_list("spans"))),
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    per = found.groupBy("doc_id", "row_key").agg(F.max("n_words").alias("n_words"), merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), row_key().alias("key"))  # rows that repeat stay as many
    return ids.join(per, ids["id"].eqNullSafe(per["doc_id"]) & (ids["key"] == per["row_key"])).drop("id", "key")


def judge(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit, n_items and contaminated: at least one word in ``share`` is hit."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, whole."""
    doc, key = (unused(docs.columns, c) for c in ("bad_doc", "bad_key"))
    bad = judge(find_contamination(docs, benchmark)).where("contaminated").select(F.col("doc_id").alias(doc), F.col("row_key").alias(key)).dropDuplicates()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[doc]) & (row_key() == bad[key]), "left_anti")
