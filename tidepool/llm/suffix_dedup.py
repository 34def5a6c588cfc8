"""Exact substring dedup with suffix arrays built by linear grouping.

A 50-byte window is named by its anchor, the 16-byte gram in it with the least
hash; equal windows have equal anchors at equal places. Consecutive windows with
one anchor are a run, and runs are dealt out by their anchor's hash.

1. A run whose whole content also stands in a smaller document goes entirely.
   Within a task this is settled before the shuffle, so a passage that many
   documents hold sends one run a task; the rest is settled after it.
2. Anchors with unlike runs are where copies begin, end or differ. The bytes of
   one run of each content are fetched; each is cut to what it can share with a
   run of the same anchor, equal cuts are counted once, and a suffix array over
   the remaining texts brings equal 50-byte windows together. The array is built
   by grouping suffixes by their Lyndon prefix, groups taken in descending
   order with pointers to the previous smaller suffix, and then laying out each
   group in order; nothing is renamed or sorted again.

Spans of both are merged per document and cut out of its bytes. Windows are
judged on the input, so what is removed elsewhere never matters.

Defined results: a null text is empty; texts under ``span`` bytes stay whole.
Rows that repeat a doc_id are one document with several texts: none loses bytes
to another, and windows don't cross them. A row without doc_id stays whole and
is no source. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import cut, row_key

SPAN, GRAM = 50, 16
#: More doc_ids that repeat with unlike texts are not broadcast.
REPEATED_IDS = 200_000
#: Bytes that are hashed at once; a text's place in them fits 24 bits.
BLOCK = 3 << 20
#: A run's numbers in one long: start 34 bits, windows 7, offset of the anchor 6, text key 16.
START_AT, COUNT_AT, OFFSET_AT = 29, 22, 16
_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _MUL)
_INVERSE = np.uint64(pow(int(_MUL), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)


def runs(texts: list[bytes], span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text, start, windows, offset of the anchor, anchor's hash, hash of the content) of every run of a block of texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    none = (np.empty(0, np.int64),) * 5 + (np.empty(0, np.uint64),)
    if not (sizes >= span).any():
        return none
    value = _BYTE[buf]
    h, base, width = value, _MUL, 1
    while width < GRAM:
        h = h[:-width] * base + h[width:]
        base, width = np.uint64(int(base) ** 2 % (1 << 64)), width * 2
    key = (_mix(h) & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    width, many = 1, span - GRAM + 1
    while 2 * width <= many:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < many:
        key = np.minimum(key[: len(key) - (many - width)], key[many - width :])
    edge = np.zeros(len(buf) + 1, np.int8)  # windows that lie within one text
    long = sizes >= span
    np.add.at(edge, begins[long], 1)
    np.add.at(edge, begins[long] + sizes[long] - span + 1, -1)
    at = np.flatnonzero(np.cumsum(edge, dtype=np.int8)[: len(key)])
    own = key[at]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.append(first, len(at)))
    start, own = at[first], own[first]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value * _powers(_MUL, len(value) - 1), dtype=np.uint64)])
    content = (sums[start + count - 1 + span] - sums[start]) * _powers(_INVERSE, len(value))[start]
    text = np.searchsorted(begins, start, side="right") - 1
    # empty texts begin where the next one does; the last of them holds the bytes
    offset = (own & np.uint64(0xFFFFFF)).astype(np.int64) - start
    return text, start - begins[text], count, offset, (own >> np.uint64(24)).astype(np.int64), _mix(content ^ count.astype(np.uint64) * _MUL)


RUN = [("anchor", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("info", pa.int64())]
RUN_DDL = "anchor long, content long, doc_id long, info long"


def _pack(start, count, offset, key):
    return (start << START_AT) | (count << COUNT_AT) | (offset << OFFSET_AT) | key


def _unpack(info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return info >> START_AT, (info >> COUNT_AT) & 127, (info >> OFFSET_AT) & 63, info & 0xFFFF


def _joined(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of (doc, key), those that touch made one."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    if not len(doc):
        return doc, key, start, end
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > end[:-1])])
    at = np.flatnonzero(new)  # all spans of a block are short and about equal, so ends ascend with starts
    return doc[at], key[at], start[at], np.maximum.reduceat(end, at)


def _emit_runs(docs: list[int], keys: list[int], offsets: list[int], texts: list[bytes], span: int) -> pa.RecordBatch:
    t, start, count, offset, anchor, content = runs(texts, span)
    doc, key = np.array(docs, np.int64)[t], np.array(keys, np.int64)[t]
    start = start + np.array(offsets, np.int64)[t]
    content = content.view(np.int64)
    order = np.lexsort((doc, content, anchor))
    t, start, count, offset, anchor, content, doc, key = (x[order] for x in (t, start, count, offset, anchor, content, doc, key))
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]) if len(anchor) else np.empty(0, bool)
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(anchor) else doc
    again = doc > least
    d, k, a, b = _joined(doc[again], key[again], start[again], start[again] + count[again] - 1 + span)
    stay = ~again
    # a settled span has no windows left; its end stands in place of the content
    info = np.concatenate([_pack(start[stay], count[stay], offset[stay], key[stay]), _pack(a, 0, 0, k)])
    place = np.concatenate([anchor[stay], (_mix((d ^ a).astype(np.uint64) * _MUL) >> np.uint64(24)).astype(np.int64)])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (place, np.concatenate([content[stay], b]), np.concatenate([doc[stay], d]), info)], names=[n for n, _ in RUN])


def _find_runs(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, keys, offsets, texts, held = [], [], [], [], 0
        for batch in batches:
            ids, ks, col = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for lo in range(0, len(ids), 256):
                for i, text in enumerate(col.slice(lo, 256).cast(pa.binary()).to_pylist(), lo):
                    text = text or b""
                    for at in range(0, max(1, len(text) - span + 1), BLOCK):  # a very long text in parts that share span - 1 bytes
                        part = text[at : at + BLOCK + span - 1]
                        if held + len(part) > BLOCK + span and texts:
                            yield _emit_runs(docs, keys, offsets, texts, span)
                            docs, keys, offsets, texts, held = [], [], [], [], 0
                        if len(part) >= span:
                            docs.append(ids[i])
                            keys.append(ks[i])
                            offsets.append(at)
                            texts.append(part)
                            held += len(part)
        if texts:
            yield _emit_runs(docs, keys, offsets, texts, span)

    return run


def _settle(span: int):
    """Over runs sorted by anchor, content, document: spans to remove, as minus their length in place of an anchor, and runs whose bytes are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64) for _ in RUN]
        done, was_many = False, False  # of the rows held over: whether asked for, whether their anchor has other contents
        for batch in batches:
            anchor, content, doc, info = (np.concatenate([r, batch.column(i).to_numpy(zero_copy_only=False)]) for i, r in enumerate(rest))
            held = np.arange(len(anchor)) < len(rest[0])
            settled = (info >> COUNT_AT) & 127 == 0
            out = [[doc[settled], info[settled], (info[settled] >> START_AT) - content[settled]]]
            anchor, content, doc, info, held = (x[~settled] for x in (anchor, content, doc, info, held))
            if len(anchor):
                new_a = np.concatenate([[True], anchor[1:] != anchor[:-1]])
                new_c = new_a | np.concatenate([[True], content[1:] != content[:-1]])
                of_a, of_c = np.cumsum(new_a) - 1, np.cumsum(new_c) - 1
                many = np.bincount(of_a[new_c], minlength=of_a[-1] + 1) > 1
                if held[0]:
                    many[0] |= was_many
                least = doc == doc[np.flatnonzero(new_c)][of_c]
                count = (info >> COUNT_AT) & 127
                out.append([doc[~least], info[~least], 1 - span - count[~least]])
                ask = least & many[of_a] & ~(held & done)
                out.append([doc[ask], info[ask], anchor[ask]])
                tail = (of_c == of_c[-1]) & least
                rest = [anchor[tail], content[tail], doc[tail], info[tail]]
                done = was_many = bool(many[-1])
            else:
                rest = [x[:0] for x in rest]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc_id", "info", "anchor"])

    return run


FOUND_DDL = "doc_id long, info long, anchor long"


def suffix_order(seq: list[int]) -> list[int]:
    """Suffix array by linear grouping; the last symbol must be the least and stand once."""
    n = len(seq)
    order = sorted(range(n), key=seq.__getitem__)
    place, start, end = [0] * n, [0] * n, [0] * n
    at = 0
    for i, s in enumerate(order):
        if i and seq[s] != seq[order[i - 1]]:
            end[at] = i
            at = i
        place[s], start[s] = i, at
    if n:
        end[at] = n
    # first: groups in descending order; a suffix that members point back to moves behind its own group
    prev = [-1] * n
    high = n
    while high:
        low = start[order[high - 1]]
        pointed: dict[int, int] = {}
        members = sorted(order[low:high]) if high - low > 1 else order[low:high]
        for s in members:
            p = s - 1
            while p >= 0 and start[p] >= low:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for p, times in pointed.items():
            moves.setdefault(times, {}).setdefault(start[p], []).append(p)
        for times in sorted(moves, reverse=True):
            for group, moved in moves[times].items():
                last = end[group]
                first = last - len(moved)
                if first == group:
                    continue
                to = last
                for p in moved:
                    to -= 1
                    other, hole = order[to], place[p]
                    order[hole], place[other] = other, hole
                    order[to], place[p] = p, to
                for p in moved:
                    start[p] = first
                end[first], end[group] = last, first
        high = low
    # then: each suffix in order puts the chain before it at the head of the groups
    out, put = [-1] * n, [False] * n
    head = list(range(n))
    if n:
        out[0], put[n - 1] = n - 1, True
        head[0] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not put[s]:
            g = start[s]
            out[head[g]] = s
            head[g] += 1
            put[s] = True
            s = prev[s]
    return out


def same_windows(texts: list[bytes], owners: list[int], span: int) -> list[list[int]]:
    """For each text, at each window start, the least owner whose text holds the window."""
    seq: list[int] = []
    where: list[int] = []
    for i, t in enumerate(texts):
        where += [i] * (len(t) + 1)
        seq += [b + len(texts) for b in t]
        seq.append(len(texts) - 1 - i)
    begins = [0]
    for t in texts:
        begins.append(begins[-1] + len(t) + 1)
    out = [[owners[i]] * max(0, len(t) - span + 1) for i, t in enumerate(texts)]
    window, members = b"", []

    def close() -> None:
        if len(members) > 1:
            least = min(owners[i] for i, _ in members)
            for i, o in members:
                out[i][o] = least

    for p in suffix_order(seq):
        i = where[p]
        o = p - begins[i]
        w = texts[i][o : o + span]
        if len(w) == span:
            if w != window:
                close()
                window, members = w, []
            members.append((i, o))
    close()
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def _shared(parts: list[bytes]) -> list[int]:
    """The longest beginning that each part shares with another."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    best = [0] * len(parts)
    for a, b in zip(order, order[1:], strict=False):
        n = _common(parts[a], parts[b])
        best[a], best[b] = max(best[a], n), max(best[b], n)
    return best


class _Differing:
    """Collects the cut texts of anchors, and settles them some ten thousand bytes at a time."""

    def __init__(self, span: int, size: int = 20_000):
        self.span, self.size = span, size
        self.texts: list[bytes] = []
        self.least: list[int] = []
        self.holders: list[list[tuple[int, int, int]]] = []
        self.spans: list[tuple[int, int, int, int]] = []

    def anchor(self, rows: list[tuple]) -> None:
        """rows: (offset, doc, key, start, content) of one anchor."""
        held: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for offset, doc, key, start, content in rows:
            held.setdefault((offset, content), []).append((doc, key, start))
        if len(held) < 2:
            return
        right = _shared([c[o:] for o, c in held])
        left = _shared([c[:o][::-1] for o, c in held])
        cuts: dict[bytes, list[tuple[int, int, int]]] = {}
        for ((offset, content), owners), r, lft in zip(held.items(), right, left, strict=True):
            if lft + r >= self.span:
                cuts.setdefault(content[offset - lft : offset + r], []).extend((d, k, s + offset - lft) for d, k, s in owners)
        for t, owners in cuts.items():
            least = min(d for d, _, _ in owners)
            self.spans += [(d, k, s, s + len(t)) for d, k, s in owners if d > least]
            if len(cuts) > 1:
                self.texts.append(t)
                self.least.append(least)
                self.holders.append([x for x in owners if x[0] == least])
        if sum(map(len, self.texts[-len(cuts) :])) and len(self.texts) * 64 >= self.size:
            self.settle()

    def settle(self) -> None:
        for owners, least, first in zip(self.holders, self.least, same_windows(self.texts, self.least, self.span), strict=True):
            hit = [o for o, f in enumerate(first) if f < least]
            for o in hit:
                self.spans += [(d, k, s + o, s + o + self.span) for d, k, s in owners]
        self.texts, self.least, self.holders = [], [], []

    def batch(self) -> pa.RecordBatch:
        cols = np.array(self.spans, np.int64).reshape(-1, 4).T
        self.spans = []
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(*cols)], names=["doc_id", "key", "start", "end"])


def _decide(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo, anchor, rows = _Differing(span), None, []
        for batch in batches:
            for a, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if a != anchor:
                    todo.anchor(rows)
                    anchor, rows = a, []
                rows.append(row)
            if len(todo.spans) > 50_000:
                yield todo.batch()
        todo.anchor(rows)
        todo.settle()
        yield todo.batch()

    return run


def _fetch(span: int):
    """The bytes of the runs asked for; a run's offset is that of its anchor."""
    types = [("anchor", pa.int64()), ("offset", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("content", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                out: list[tuple] = []
                for doc, text, asked in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    for x in asked or ():
                        info = x["info"]
                        start = info >> START_AT
                        out.append((x["anchor"], (info >> OFFSET_AT) & 63, doc, info & 0xFFFF, start, text[start : start + ((info >> COUNT_AT) & 127) - 1 + span]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*out, strict=True), types, strict=True)], names=[n for n, _ in types])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())]
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            out = []
            for doc, text, spans in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                text = text or b""
                merged: list[list[int]] = []
                for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(text[at:s])
                    at = e
                kept.append(text[at:])
                out.append((doc, len(text), sum(e - s for s, e in merged), len(merged), [{"start": s, "end": e} for s, e in merged], b"".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*out, strict=True), types, strict=True)], names=[n for n, _ in types])


def _told_apart(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: key numbers the unlike texts of one doc_id, told apart by 64 bits of hash; equal rows share it."""
    hashed = docs.select("doc_id", row_key().alias("h"))
    many = cut(hashed.where("doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("doc_id"))
    repeated = many.count()
    if not repeated:
        # 0, but no literal: that would fall out of the joins' keys, and the texts would be shuffled again for each
        return docs.select("doc_id", F.col("doc_id").bitwiseAND(F.lit(0)).alias("key"), "text")
    hint = F.broadcast if repeated <= REPEATED_IDS else lambda df: df
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1
    place = F.when(number > 0xFFFF, F.raise_error(F.lit("a doc_id has over 65,536 unlike texts")).cast("int")).otherwise(number)
    keys = cut(hashed.join(hint(many), "doc_id").distinct().withColumn("key", place))
    keys = F.broadcast(keys) if keys.count() <= REPEATED_IDS else keys
    return docs.withColumn("h", row_key()).join(keys, ["doc_id", "h"], "left").select("doc_id", F.coalesce("key", F.lit(0)).cast("long").alias("key"), "text")


def dedup_substrings(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (byte ranges removed), kept (the bytes left): one row a document."""
    if not GRAM < span <= 64:
        raise ValueError("span must be over 16 and at most 64 bytes")
    own = _told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")))
    dealt = own.where("doc_id is not null").mapInArrow(_find_runs(span), RUN_DDL).repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id")
    found = cut(dealt.mapInArrow(_settle(span), FOUND_DDL))

    # the texts are shuffled once: both joins below read the same exchange
    texts = own.repartition("doc_id", "key")
    of_text = [F.col("doc_id").alias("d"), F.col("info").bitwiseAND(F.lit(0xFFFF)).alias("k")]
    there = (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k"))
    asked = found.where("anchor >= 0").groupBy(*of_text).agg(F.collect_list(F.struct("anchor", "info")).alias("asked"))
    content = texts.join(asked.hint("shuffle_hash"), there, "left").select("doc_id", "text", "asked").mapInArrow(_fetch(span), "anchor long, offset long, doc_id long, key long, start long, content binary")
    decided = content.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_decide(span), "doc_id long, key long, start long, end long")

    start = F.shiftright("info", START_AT)
    known = found.where("anchor < 0").select(*of_text, start.alias("start"), (start - F.col("anchor")).alias("end"))
    spans = known.unionByName(decided.withColumnsRenamed({"doc_id": "d", "key": "k"}))
    per = spans.groupBy("d", "k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = texts.join(per.hint("shuffle_hash"), there, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary")
