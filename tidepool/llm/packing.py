"""Sum-of-squares online packing of tokenized documents.

A task tokenizes its documents and packs them as they come. Whole windows of a
long document are closed at once. What is left goes to the fill level at which
the sum over levels of the squared count of partially filled windows grows
least; the counts stand in one array indexed by level. At the end of a task the
windows that are still open are emptied, the fullest first, into a few: pieces
are cut where a window is full, and the last window is cut into powers of two,
which need no padding. So padding does not grow with the number of tasks.

A task keeps its level array, its open windows (at most one a level: see
``_Packer``) and the token cache, all of bounded size; nothing is shuffled.

Defined results: a null text is empty; each document ends with ``end_id``, so an
empty one has one token. Equal rows are packed each on its own. Extra columns
are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Chunks whose ids a worker remembers before it starts anew.
CACHE_WORDS = 1_200_000


class _Index(dict):
    """Numbers chunks as they are first seen, and notes them."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


#: The only normalizer and pre-tokenizer for which ``WordCache`` puts ids together from chunks.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def has_known_rules(path: str) -> bool:
    """Whether ids may be put together from chunks: these rules alone, and added tokens that hold a < and no white space."""
    import json

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    plain = rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER
    plain = plain and not any(rules.get(x) for x in ("truncation", "padding")) and not rules["model"].get("dropout")
    own = all("<" in t["content"] and t["content"].split() == [t["content"]] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in rules.get("added_tokens", ()))
    return plain and own


class WordCache:
    """Token ids of texts by way of their space-separated chunks.

    Under the rules of ``has_known_rules`` white space is dropped and no piece
    crosses it, so a text's ids are those of its chunks in order; a chunk's ids
    are computed once. ASCII letters are a piece of their own before a full stop
    or comma, whatever their case, so such chunks are put together from known
    ones. Letters beyond ASCII are not: some fall apart into letter and mark in
    lower case, and a mark joins the full stop. With any other tokenizer each
    text is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = has_known_rules(path)
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.flat = np.empty(1 << 20, np.uint32)
        self.used = 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _room(self, ids: int) -> None:
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.index) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])

    def _tokenize(self, words: list[str]) -> None:
        # one call for many words: a newline between two chunks parts them, and ids are cut by character place
        for at in range(0, len(words), 4096):
            block = words[at : at + 4096]
            enc = self.tokenizer.encode("\n".join(block), add_special_tokens=False)
            ids = np.array(enc.ids, np.uint32)
            first = np.array([o[0] for o in enc.offsets], np.int64)
            ends = np.cumsum(np.array([len(w) + 1 for w in block], np.int64))
            sizes = np.bincount(np.searchsorted(ends, first, side="right"), minlength=len(block))
            self._room(len(ids))
            self.flat[self.used : self.used + len(ids)] = ids
            slots = np.array([self.index[w] for w in block])
            self.starts[slots] = self.used + np.cumsum(sizes) - sizes
            self.sizes[slots] = sizes
            self.used += len(ids)

    def _learn(self) -> None:
        index, fresh = self.index, self.index.fresh
        whole, parts = [], []
        for w in fresh:
            base = w.lower() if w.isascii() and "<" not in w else w  # special tokens are told apart by case
            if base[-1:] in (".", ",") and base[:-1].isalpha() and base.isascii():
                parts.append((w, base[:-1], base[-1]))
            elif base != w:
                parts.append((w, base, ""))
            else:
                whole.append(w)
        index.fresh = []
        for _, base, end in parts:
            index[base]
            index[end]
        self._tokenize(whole + index.fresh)
        index.fresh = []
        if not parts:
            return
        w, base, end = (np.array([index[p[i]] for p in parts]) for i in range(3))
        sizes = self.sizes[base] + self.sizes[end]
        n = int(sizes.sum())
        self._room(n)
        self.starts[w] = self.used + np.cumsum(sizes) - sizes
        self.sizes[w] = sizes
        self.flat[self.used : self.used + n] = self._ids(np.stack([base, end], 1).ravel())
        self.used += n

    def _ids(self, slots: np.ndarray) -> np.ndarray:
        n = self.sizes[slots]
        step = np.repeat(self.starts[slots] - (np.cumsum(n) - n), n)
        return self.flat[step + np.arange(len(step))]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if not self.by_chunk:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.index) > CACHE_WORDS:
            self._clear()
        get, slots = self.index.__getitem__, []
        for t in texts:
            chunks = t.replace("\n", " ").split(" ")
            slots.append(np.fromiter(map(get, chunks), np.int64, len(chunks)))
        if self.index.fresh:
            self._learn()
        return [self._ids(s) for s in slots]


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """One cache a worker process, which serves the tasks that it runs in turn."""
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


class _Packer:
    """Windows of ``size`` tokens; a piece is (doc, start, ids)."""

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # partially filled windows by level; 0 and size stay 0
        self.open: dict[int, list[list]] = {}
        self.closed: list[list] = []

    def level_for(self, n: int) -> int:
        """The fill level whose choice makes the sum of squared counts least; the fullest of equals. 0: a new window."""
        grow = 2 * (self.count[n : self.size] + 1) - 1  # levels n to size - 1 gain a window
        gain = np.append(grow, 0)  # a full window leaves the array
        loss = 2 * self.count[: self.size - n + 1] - 1  # level h loses one
        loss[0] = 0
        total = np.where(self.count[: self.size - n + 1] > 0, gain - loss, np.iinfo(np.int64).max)
        total[0] = gain[0]
        return int(len(total) - 1 - np.argmin(total[::-1]))

    def put(self, doc, doc_tokens: int, start: int, ids: np.ndarray) -> None:
        n = len(ids)
        if n == self.size:
            self.closed.append([(doc, doc_tokens, start, ids)])
            return
        level = self.level_for(n)
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        window.append((doc, doc_tokens, start, ids))
        if level + n == self.size:
            self.closed.append(window)
        else:
            self.open.setdefault(level + n, []).append(window)
            self.count[level + n] += 1

    def add(self, doc, ids: np.ndarray) -> None:
        for at in range(0, len(ids), self.size):
            self.put(doc, len(ids), at, ids[at : at + self.size])
        if int(self.count.sum()) > self.size:  # as many open windows as levels: memory stays bounded
            self.top_up(keep_last=True)

    def top_up(self, keep_last: bool = False) -> None:
        """Fills the fullest open windows with pieces cut from the emptiest."""
        levels = sorted(((h, w) for h, ws in self.open.items() for w in ws), key=lambda x: x[0])
        self.open, self.count[:] = {}, 0
        low, high = 0, len(levels) - 1
        while low < high:
            h, window = levels[high]
            room = self.size - h
            while room and low < high:
                left, source = levels[low]
                doc, total, start, ids = source.pop()
                take = min(room, len(ids))
                window.append((doc, total, start + len(ids) - take, ids[len(ids) - take :]))
                if take < len(ids):
                    source.append((doc, total, start, ids[: len(ids) - take]))
                room -= take
                levels[low] = (left - take, source)
                if left == take:
                    low += 1
            if room:
                levels[high] = (self.size - room, window)
            else:
                self.closed.append(window)
                high -= 1
        if low == high and levels:
            h, window = levels[low]
            if h == self.size:
                self.closed.append(window)
            elif keep_last:
                self.open[h], self.count[h] = [window], 1
            else:
                self._in_powers(window, h)

    def _in_powers(self, window: list, h: int) -> None:
        pieces = window[::-1]
        for bit in reversed(range(h.bit_length())):
            want = h & (1 << bit)
            part = []
            while want:
                doc, total, start, ids = pieces.pop()
                take = min(want, len(ids))
                part.append((doc, total, start, ids[:take]))
                if take < len(ids):
                    pieces.append((doc, total, start + take, ids[take:]))
                want -= take
            if part:
                self.closed.append(part)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row a piece, by SCHEMA; with_ids adds the piece's token ids, to be written out as training input."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))
        cache, packer = word_cache(tokenizer_path), _Packer(window)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def flush() -> pa.RecordBatch:
            nonlocal number
            rows = []
            for seq in packer.closed:
                at = 0
                for doc, total, start, ids in seq:
                    raw = np.ascontiguousarray(ids, dtype="<u4")
                    rows.append((doc, start, len(ids), zlib.crc32(raw.tobytes()), total, number, at, *([raw.astype(np.int32)] if with_ids else [])))
                    at += len(ids)
                number += 1
            packer.closed = []
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(arrow)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                for doc, tokens in zip(ids[at : at + 256], cache.encode(part), strict=True):
                    packer.add(doc, np.append(tokens, np.uint32(end_id)))
            yield flush()
        packer.top_up()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
